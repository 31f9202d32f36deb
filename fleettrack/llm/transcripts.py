"""Transcript parsing by a hidden Markov model, and canonical rendering of turns.

A transcript is a run of lines. States are (role, begins a turn or goes on); what is seen of a line is its speaker marker, if any,
whether it opens the transcript or follows a blank line, its length and its last sign. Emission and transition probabilities are smoothed counts
over lines of known roles; Viterbi recovers the roles, over many transcripts at a time. Transcripts of many rows are cut into blocks: each
block's best scores between any two states form a matrix (one for each case of what stands before it), the matrices of a transcript are
chained, every block is decoded with its known ends, and turns that go on over a border are put together, so the result is that of one piece.

Contracts: null texts are empty turns; null and unknown roles are not learned from; a row without a conversation id is a transcript of its
own; rows of equal places are ordered by hash and text, each with all its lines; null turns come first; markers are cut off; without any known role every line is the
user's; an empty table gives no rows; extra columns are ignored. A block has some `BLOCK` rows; one row's text is never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Speaker names that hint at a role. Fixed values.
NAMES = {"system": "system|instructions?|setup", "user": "user|human|question|q|customer|prompter|you", "assistant": "assistant|bot|ai|answer|a|agent|model"}
MARKER = re.compile(r"^\s*(?:[#*>\[<|]+\s*)?(?:" + "|".join(f"(?P<{r}>{n})" for r, n in NAMES.items()) + r")\s*(?:\|?[\]>]|[:.)*]+)[:>]*\s*", re.IGNORECASE)
#: What is seen of a line: marker, opens, follows a blank line, length, last sign.
KINDS, OPENS, BLANK_BEFORE = 5, 1, 2
STATES = 2 * len(ROLES)
BLOCK = 512
#: Lines that a task decodes at a time, about.
HELD = 20_000


def marker(line: str) -> tuple[int, int]:
    """(0 for none or 1 + the role that the marker hints at, where the words start)."""
    m = MARKER.match(line)
    return (1 + ROLES.index(m.lastgroup), m.end()) if m else (0, 0)


def features(lines: list[str], first: np.ndarray, opens: np.ndarray, blank_before: np.ndarray) -> np.ndarray:
    """A row of KINDS small numbers for each line. At the places `first`, runs begin: `opens` and `blank_before` say what holds there."""
    out = np.zeros((len(lines), KINDS), np.int64)
    blank = np.zeros(len(lines), np.int64)
    for k, line in enumerate(lines):
        tail = line.rstrip()[-1:]
        blank[k] = not tail
        out[k, 0], out[k, 3], out[k, 4] = marker(line)[0], min(3, len(line) // 60), (1 if tail == "?" else 0) if tail else 2
    out[1:, BLANK_BEFORE] = blank[:-1]
    out[first, BLANK_BEFORE] = blank_before
    out[first, OPENS] = opens
    return out


class Model:
    """Log probabilities: start (S), move (S, S), emit (KINDS, S, 4); state 2r begins a turn of role r, 2r+1 goes on."""

    def __init__(self, start=None, move=None, emit=None):
        s = STATES
        self.start = np.log(np.full(s, 0.5) if start is None else start)
        self.move = np.log(np.full((s, s), 0.5) if move is None else move)
        self.emit = np.log(np.full((KINDS, s, 4), 0.25) if emit is None else emit)
        for r in range(len(ROLES)):  # a turn goes on with its own role only; it has to begin
            self.start[2 * r + 1] = -1e9
            for q in range(s):
                if q // 2 != r:
                    self.move[q, 2 * r + 1] = -1e9

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(self.emit[k][:, seen[:, k]].T for k in range(KINDS))

    def through(self, seen: np.ndarray, first: bool) -> np.ndarray:
        """(S, S): the best score from each state before the run to each state at its end; for a transcript's first run all rows are alike."""
        score = self.scores(seen)
        best = (np.tile(self.start, (STATES, 1)) if first else self.move) + score[0][None, :]
        for row in score[1:]:
            best = (best[:, :, None] + self.move[None, :, :]).max(1) + row[None, :]
        return best

    def viterbi(self, seen: np.ndarray, size: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The states of all lines of many runs of `size` lines each; `before` and `last` are the states before a run and at its end, -1 where free."""
        score, ends = self.scores(seen), np.cumsum(size)
        out = np.zeros(len(seen), np.int64)
        order = np.argsort(-size, kind="stable")
        n, first = size[order], (ends - size)[order]
        best = np.where((before[order] < 0)[:, None], self.start, self.move[before[order]]) + score[first]
        back = []
        live = len(order)
        for t in range(1, int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -t, "left"))  # runs of more than t lines come first
            step = best[:live, :, None] + self.move
            back.append(step.argmax(1).astype(np.int8))
            best[:live] = step.max(1) + score[first[:live] + t]
        state = np.where(last[order] < 0, best.argmax(1), last[order])
        for t in range(int(n[0]) - 1 if len(n) else -1, -1, -1):
            live = int(np.searchsorted(-n, -t, "left"))
            out[first[:live] + t] = state[:live]
            if t:
                live = len(back[t - 1])
                state[:live] = back[t - 1][np.arange(live), state[:live]]
        return out


def transcripts_of(turns: DataFrame, spoken: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", block: int = BLOCK) -> DataFrame:
    """(conv, turn, role, text, h, block, sub): the rows of transcripts with `spoken`, their raw text; (block, sub) is the run of rows to which a row belongs, in order."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(F.col(role).isin(*ROLES), F.array_position(F.array(*map(F.lit, ROLES)), F.col(role)) - 1).cast("int").alias("role"), F.coalesce(spoken, F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "block": F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-(1 << 40)))})
    # turns that repeat very often make a block large: it is cut by turn and hash
    large = rows.where("conv IS NOT NULL").groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * block)
    large = large.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), F.ceil(F.col("n") / block).cast("long").alias("slots"))
    slot = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("slots")).cast("long")
    sub = F.when(F.col("slots").isNull(), 0).otherwise(F.coalesce(F.col("turn") - F.col("block") * block, F.lit(0)) * (F.col("slots") + 1) + slot)
    return rows.join(large, (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b")), "left").select("conv", "turn", "role", "text", "h", "block", sub.cast("long").alias("sub"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Each run of rows in one partition, in order."""
    spread = F.when(F.col("conv").isNull(), F.col("h")).otherwise(F.xxhash64("conv", "block", "sub"))
    return rows.withColumn("_to", spread).repartition("_to").sortWithinPartitions("conv", "block", "sub", "turn", "h", "text").drop("_to")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[dict]]]:
    """Runs of rows, some HELD lines at a time."""
    out: list[list[dict]] = []
    held, last = 0, None
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            for r in batch.slice(a, 1024).to_pylist():
                key = (r["conv"], r["block"], r["sub"])
                if key != last or r["conv"] is None:
                    if held > HELD:
                        yield out
                        out, held = [], 0
                    out.append([])
                    last = key
                r["lines"] = r.pop("text").split("\n")
                held += len(r["lines"])
                out[-1].append(r)
    if out:
        yield out


def _lines(runs: list[list[dict]]) -> tuple[list[str], np.ndarray, list[dict]]:
    """(all lines, lines of each run, all rows)."""
    rows = [r for run in runs for r in run]
    return [x for r in rows for x in r["lines"]], np.array([sum(len(r["lines"]) for r in run) for run in runs], np.int64), rows


def _opening(rows: DataFrame) -> DataFrame:
    """The first run of each transcript that has several: (_c, _b, _s, runs)."""
    runs = rows.where("conv IS NOT NULL").groupBy("conv", "block", "sub").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("conv").agg(F.min(F.struct("block", "sub")).alias("f"), F.count(F.lit(1)).alias("runs")).where("runs > 1").select(F.col("conv").alias("_c"), F.col("f.block").alias("_b"), F.col("f.sub").alias("_s"))


def learn(rows: DataFrame) -> Model:
    """Smoothed counts over all lines with a known role; what is gathered has a fixed size. The first line of a transcript's second and further runs is left out, as its neighbour is elsewhere."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((KINDS + 2, STATES, STATES), np.int64)
        for runs in _runs(batches):
            lines, size, every = _lines(runs)
            first = np.cumsum(size) - size
            opens = np.array([run[0]["later"] is None for run in runs])
            seen = features(lines, first, opens, np.zeros(len(first), np.int64))
            truth = np.concatenate([np.where(np.arange(len(r["lines"])) > 0, 2 * r["role"] + 1, 2 * r["role"]) if r["role"] is not None else np.full(len(r["lines"]), -1) for r in every])
            use = truth >= 0
            use[first[~opens]] = False
            for k in range(KINDS):
                np.add.at(total[k], (truth[use], seen[use, k]), 1)
            pair = np.flatnonzero((truth[1:] >= 0) & (truth[:-1] >= 0))
            pair = pair[~np.isin(pair + 1, first)]
            np.add.at(total[KINDS], (truth[pair], truth[pair + 1]), 1)
            begin = truth[first[opens]]
            np.add.at(total[KINDS + 1], (begin[begin >= 0], 0), 1)
        what, s, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(s), pa.array(v), pa.array(total[what, s, v])], names=["what", "s", "v", "n"])

    later = _opening(rows)
    known = rows.join(later, F.col("conv") == F.col("_c"), "left").withColumn("later", F.when(F.col("_c").isNotNull() & ((F.col("block") != F.col("_b")) | (F.col("sub") != F.col("_s"))), 1)).drop("_c", "_b", "_s")
    found = _dealt(known).mapInArrow(count, "what long, s long, v long, n long").groupBy("what", "s", "v").agg(F.sum("n").alias("n")).collect()
    start, move, emit = np.full(STATES, 0.5), np.full((STATES, STATES), 0.5), np.full((KINDS, STATES, 4), 0.5)
    for r in found:
        if r["what"] < KINDS:
            emit[r["what"], r["s"], r["v"]] += r["n"]
        elif r["what"] == KINDS:
            move[r["s"], r["v"]] += r["n"]
        else:
            start[r["s"]] += r["n"]
    if not found:
        start[2] = 1e6
        move[:, 3] = 1e6
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(2, keepdims=True))


MATRICES = "conv {0}, block long, sub long, first int, plain array<double>, after_blank array<double>, ends_blank int"
ENDS = "conv {0}, block long, sub long, before int, last int, follows_blank int"
TURNS = "conv {0}, block long, sub long, part long, goes_on boolean, first_turn long, role string, text string, n_lines long"


def _ends(rows: DataFrame, model: Model, kind: str) -> DataFrame:
    """Of transcripts with several runs: the states before and at the end of each run, and whether a blank line stands before it."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for runs in _runs(batches) for x in runs):
            lines, _, every = _lines([batch])
            first, zero = every[0]["first"], np.zeros(1, np.int64)
            mats = [model.through(features(lines, zero, np.array([first]), np.array([b])), bool(first)).ravel().tolist() for b in (0, 1)]
            values = [every[0]["conv"], every[0]["block"], every[0]["sub"], first, *mats, int(not lines[-1].strip())]
            kinds = [batch_kind, pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["conv", "block", "sub", "first", "plain", "after_blank", "ends_blank"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "sub"])
        best, back, blank, follows = None, [], 0, []
        for plain, after, ends_blank in zip(pdf["plain"], pdf["after_blank"], pdf["ends_blank"], strict=True):
            m = np.array(after if blank else plain).reshape(STATES, STATES)
            follows.append(blank)
            step = m if best is None else best[:, None] + m
            back.append(step.argmax(0))
            best = step[0] if best is None else step.max(0)  # the first run's rows are all alike: its start is free of what is before
            blank = ends_blank
        ends = [int(best.argmax())]
        for b in reversed(back[1:]):
            ends.append(int(b[ends[-1]]))
        ends = ends[::-1]
        return pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "sub": pdf["sub"], "before": [-1, *ends[:-1]], "last": ends, "follows_blank": follows})

    from pyspark.sql.pandas.types import to_arrow_type

    batch_kind = to_arrow_type(rows.schema["conv"].dataType)
    several = rows.join(_opening(rows), F.col("conv") == F.col("_c")).withColumn("first", ((F.col("block") == F.col("_b")) & (F.col("sub") == F.col("_s"))).cast("int")).drop("_c", "_b", "_s")
    return _dealt(several).mapInArrow(through, MATRICES.format(kind)).groupBy("conv").applyInPandas(chain, ENDS.format(kind))


def recover(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of `transcripts_of` to turns: one row (conv, turn_no, first_turn, role, text, n_lines, rendered) for each recovered turn."""
    kind = dict(rows.dtypes)["conv"]
    from pyspark.sql.pandas.types import to_arrow_type

    conv_kind = to_arrow_type(rows.schema["conv"].dataType)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _runs(batches):
            lines, size, every = _lines(runs)
            first = np.cumsum(size) - size
            free = lambda k, name: -1 if runs[k][0][name] is None else runs[k][0][name]
            before, last, blank = (np.array([free(k, c) for k in range(len(runs))], np.int64) for c in ("before", "last", "follows_blank"))
            seen = features(lines, first, before < 0, np.maximum(blank, 0))
            state = model.viterbi(seen, size, before, last).tolist()
            turn = [r["turn"] for r in every for _ in r["lines"]]
            out: list[list] = []
            for run, a, n in zip(runs, first.tolist(), size.tolist(), strict=True):
                part = -1
                for k in range(a, a + n):
                    s, line = state[k], lines[k]
                    if s % 2 == 0 or part < 0:
                        part += 1
                        words = line[marker(line)[1] :] if s % 2 == 0 else line
                        out.append([run[0]["conv"], run[0]["block"], run[0]["sub"], part, s % 2 == 1, turn[k], ROLES[s // 2], [words], 0])
                    else:
                        out[-1][7].append(line)
            for x in out:
                x[8] = len(x[7])
                x[7] = "\n".join(x[7])
            kinds = [conv_kind, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv", "block", "sub", "part", "goes_on", "first_turn", "role", "text", "n_lines"])

    ends = _ends(rows, model, kind).select(F.col("conv").alias("_c"), F.col("block").alias("_b"), F.col("sub").alias("_s"), "before", "last", "follows_blank")
    both = rows.join(ends, (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b")) & (F.col("sub") == F.col("_s")), "left").drop("_c", "_b", "_s")
    turns = _dealt(both).mapInArrow(decode, TURNS.format(kind))
    # numbers over the runs of a transcript; a run's first turn may go on from the run before
    per_run = turns.where("conv IS NOT NULL").groupBy("conv", "block", "sub").agg(F.sum((~F.col("goes_on")).cast("long")).alias("k"), F.max(F.col("goes_on").cast("long")).alias("g"))
    w = Window.partitionBy("conv").orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, -1)
    base = per_run.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), F.col("sub").alias("_s"), (F.coalesce(F.sum("k").over(w), F.lit(0)) - F.col("g")).alias("base"), F.count(F.lit(1)).over(Window.partitionBy("conv")).alias("runs")).where("runs > 1")
    numbered = turns.join(base, (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b")) & (F.col("sub") == F.col("_s")), "left")
    numbered = numbered.withColumn("turn_no", F.coalesce("base", F.lit(0)) + F.col("part"))
    whole = numbered.where("runs IS NULL").select("conv", "turn_no", "first_turn", "role", "text", "n_lines")
    parts = numbered.where("runs IS NOT NULL").groupBy("conv", "turn_no").agg(F.sort_array(F.collect_list(F.struct("block", "sub", "part", "first_turn", "role", "text"))).alias("p"), F.sum("n_lines").alias("n_lines"))
    joined = parts.select("conv", "turn_no", F.col("p")[0]["first_turn"].alias("first_turn"), F.col("p")[0]["role"].alias("role"), F.array_join(F.transform("p", lambda x: x.text), "\n").alias("text"), "n_lines")
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.trim("text"), F.lit("\n<|end|>\n"))
    return whole.unionByName(joined).withColumn("rendered", rendered)


def spoken_text(conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Column:
    """A turn as a raw transcript has it: the conversation's style of marker (one of four by its id), which a third of the fourth style's turns lack."""
    style = F.pmod(F.xxhash64(conv), F.lit(4))
    lone = (style == 3) & (F.pmod(F.xxhash64(conv, turn), F.lit(3)) == 0)
    named = lambda names: F.element_at(F.create_map(*[x for r, n in zip(ROLES, names, strict=True) for x in (F.lit(r), F.lit(n))]), F.col(role))
    mark = F.when(lone, "").when(style == 1, named(["Instructions> ", "Human> ", "Bot> "])).when(style == 2, named(["[system] ", "[user] ", "[assistant] "])).otherwise(named(["System: ", "User: ", "Assistant: "]))
    return F.concat(F.coalesce(mark, F.lit("")), F.coalesce(F.col(text), F.lit("")))


def held_out(conv: str = "conv_id") -> Column:
    """A quarter of the conversations by the hash of their id; none without an id."""
    return F.coalesce(F.crc32(F.col(conv).cast("string").cast("binary")) % 4 == 2, F.lit(False))
