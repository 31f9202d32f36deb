"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens: its documents in stored order, each followed by the end id. Every window of `window` tokens takes
from each queue its target share (`targets`, or the corpus' own shares), and what rounding leaves is carried on as a deficit to the next
window. An empty queue leaves its share to the others. To run on many machines the windows are cut into groups of about `group_windows`:
where every queue stands at a group's start follows from the queues' totals and targets alone (`Mixture`), and the fraction of a
token that this leaves is the deficit with which the group's round-robin starts, so deficits are carried over groups (partitions)
too, and any task can make a group's schedule anew.

More sources than `max_queues` share queues by hash, but for those with a target; within a shared queue a second round-robin orders the documents by how
far their source has got, so no source is more than a document ahead of the others or behind them.

Contracts: null text is an empty text (its end id alone is packed); null, repeated and clashing doc_ids and extra columns are
carried or ignored; a null source is a queue of its own; an empty table gives no pieces; very long documents are cut over windows and groups.
"""

from __future__ import annotations

import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty
from .pretokens import chunks, ids_of, piece_table

TOKENS = "block long, source string, pos long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, owed double"
#: Parts of a shared queue, each ordered on its own.
SLOTS = 4096
#: Up to so many bytes, the places where the tokens of each block and source start are sent to every executor, and the stored ids are not shuffled.
FEW_STARTS = 16 << 20


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its block (a run of documents in one task), its source ("=" and the name; "" for null), its place among the source's tokens in the block, and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, table, at = TaskContext.get().partitionId(), piece_table(tokenizer_path), {}
        for batch in slices(batches, 512):
            texts = batch.column("text").to_pylist()
            ids, sizes = [], []
            for a, b in chunks(texts):
                part, n = ids_of(texts[a:b], table)
                ends = np.cumsum(n)
                for e, k in zip(ends.tolist(), n.tolist(), strict=True):
                    ids.append(np.append(part[e - k : e], np.uint16(end_id)).tobytes())
                    sizes.append(k + 1)
            pos = []
            for q, n in zip(batch.column("source").to_pylist(), sizes, strict=True):
                pos.append(at.get(q, 0))
                at[q] = pos[-1] + n
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(sizes), pa.int64()), batch.column("source"), pa.array(pos, pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["block", "source", "pos", "doc_id", "n", "ids"])

    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), source.alias("source")).mapInArrow(run, TOKENS)


class Mixture:
    """Where each queue stands when `drawn` tokens have left all of them, each at a rate in proportion to its weight until it is empty."""

    def __init__(self, totals: list[int], weights: list[int]):
        self.totals, self.weights, self.total = totals, weights, sum(totals)
        ends = sorted(range(len(totals)), key=lambda k: Fraction(totals[k], weights[k]))
        active, drawn, clock = sum(weights), Fraction(0), Fraction(0)
        self.phases: list[tuple[Fraction, Fraction, int]] = []  # (drawn, clock, weight of the queues that are not empty) at the phase's start
        for k in ends:
            end = Fraction(totals[k], weights[k])
            if end > clock or not self.phases:
                self.phases.append((drawn, clock, active))
                drawn, clock = drawn + (end - clock) * active, end
            active -= weights[k]

    def stand(self, drawn: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens taken from each queue, the fraction of a token that each is owed)."""
        if drawn >= self.total:
            return np.array(self.totals, np.int64), np.zeros(len(self.totals))
        at, clock, active = next(p for p in reversed(self.phases) if p[0] <= drawn)
        clock += (drawn - at) / active
        exact = [min(Fraction(t), w * clock) for t, w in zip(self.totals, self.weights, strict=True)]
        taken = [int(x) for x in exact]
        return np.array(taken, np.int64), np.array([float(x - n) for x, n in zip(exact, taken, strict=True)])

    def drawn(self, queue: int, place: int) -> float:
        """About how many tokens have left all queues when token `place` of `queue` leaves."""
        clock = Fraction(place, self.weights[queue])
        at, start, active = next(p for p in reversed(self.phases) if p[1] <= clock)
        return float(at + (clock - start) * active)


class Schedule:
    """The deficit round-robin of one group: for each queue, the tokens taken before each window (`cum`), where in a window they go (`off`), and what it is owed after it (`owed`)."""

    def __init__(self, rest: np.ndarray, carried: np.ndarray, weights: np.ndarray, window: int):
        rest, deficit = rest.copy(), carried.astype(float)
        windows = -(-int(rest.sum()) // window)
        self.cum = np.zeros((len(rest), windows + 1), np.int64)
        self.off, self.owed = np.zeros((len(rest), windows), np.int64), np.zeros((len(rest), windows))
        for w in range(windows):
            live = rest > 0
            deficit = np.where(live, deficit + window * np.where(live, weights, 0) / weights[live].sum(), 0.0)
            take = np.minimum(np.maximum(np.floor(deficit + 1e-9), 0), rest).astype(np.int64)
            space = min(window, int(rest.sum())) - int(take.sum())
            while space < 0:  # carried deficits can exceed a window together
                back = np.argsort(deficit - take, kind="stable")
                back = back[take[back] > 0][:-space]
                take[back] -= 1
                space += len(back)
            while space > 0:
                owed = np.argsort(take - deficit, kind="stable")
                owed = owed[rest[owed] > take[owed]]
                add = np.minimum(rest[owed] - take[owed], max(1, space // len(owed)))
                add = np.minimum(add, np.maximum(space - (np.cumsum(add) - add), 0))
                take[owed] += add
                space -= int(add.sum())
            deficit -= take
            rest -= take
            self.cum[:, w + 1] = self.cum[:, w] + take
            self.off[1:, w] = np.cumsum(take)[:-1]
            self.owed[:, w] = deficit


class Plan:
    """Groups of windows over all queues."""

    def __init__(self, totals: list[int], weights: list[int], window: int, group_windows: int):
        self.mixture, self.window = Mixture(totals, weights), window
        slack = min(len(totals), window // 2)  # rounding gives a group up to a token more or less from each queue
        self.size = window * group_windows - slack
        self.groups = max(1, -(-sum(totals) // self.size))
        self.stride = group_windows + 1 + len(totals) // window
        self.stands: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.known: OrderedDict[int, Schedule] = OrderedDict()
        self.near: dict[int, int] = {}
        self.most = max(2, min(256, (16 << 20) // (24 * group_windows * max(1, len(totals)))))

    def stand(self, group: int) -> tuple[np.ndarray, np.ndarray]:
        if group not in self.stands:
            while len(self.stands) >= 4 * self.most:
                self.stands.popitem(last=False)
            self.stands[group] = self.mixture.stand(self.mixture.total if group >= self.groups else group * self.size)
        self.stands.move_to_end(group)
        return self.stands[group]

    def schedule(self, group: int) -> Schedule:
        if group not in self.known:
            while len(self.known) >= self.most:
                self.known.popitem(last=False)
            (first, carried), (last, _) = self.stand(group), self.stand(group + 1)
            self.known[group] = Schedule(last - first, carried, np.array(self.mixture.weights, float), self.window)
        self.known.move_to_end(group)
        return self.known[group]

    def group_of(self, queue: int, place: int) -> int:
        group = self.near.get(queue, -1)
        if group >= 0 and self.stand(group)[0][queue] <= place < self.stand(group + 1)[0][queue]:
            return group  # as for this queue's last piece
        group = min(self.groups - 1, int(self.mixture.drawn(queue, place) / self.size))
        while self.stand(group)[0][queue] > place:
            group -= 1
        while self.stand(group + 1)[0][queue] <= place:
            group += 1
        self.near[queue] = group
        return group

    def order(self, queues: list[int], places: np.ndarray) -> np.ndarray:
        """Rows as their first tokens leave the queues, however far the queues have got where the rows lie: each schedule is made once."""
        return np.argsort(places / np.array(self.mixture.weights, float)[queues], kind="stable")

    def pieces(self, queue: int, place: int, n: int) -> Iterator[tuple[int, int, int, int, float]]:
        """(first token, number of tokens, sequence, offset, owed) for each piece of n tokens from `place` of a queue."""
        done = 0
        while done < n:
            group = self.group_of(queue, place + done)
            first, last = int(self.stand(group)[0][queue]), int(self.stand(group + 1)[0][queue])
            plan = self.schedule(group)
            cum, off = plan.cum[queue], plan.off[queue]
            here, stop = place + done - first, min(place + n, last) - first
            w = int(np.searchsorted(cum, here, "right")) - 1
            while here < stop:
                end = min(stop, int(cum[w + 1]))
                if end > here:
                    yield done, end - here, group * self.stride + w, int(off[w]) + here - int(cum[w]), float(plan.owed[queue, w])
                    done += end - here
                    here = end
                w += 1


_plans: dict[str, Plan] = {}


def _plan(key: str, *made_of) -> Plan:
    """The plan of one packing; a worker process keeps the last one, with its schedules, for its next tasks."""
    if key not in _plans:
        _plans.clear()
        _plans[key] = Plan(*made_of)
    return _plans[key]


def weights_of(totals: dict[str, int], targets: Mapping[str | None, float] | None) -> list[int]:
    """Whole-number weights of the queues, in order of their names. Queues without a target share by size what the targets leave of 1 (or come last where that is nothing)."""
    names = sorted(totals)
    if not targets:
        return [totals[q] for q in names]
    named = {"" if k is None else f"={k}": v for k, v in targets.items()}
    if min(named.values()) <= 0:
        raise ValueError("targets must be above 0")
    free = max(1.0 - sum(v for k, v in named.items() if k in totals), 1e-6)
    others = sum(t for q, t in totals.items() if q not in named)
    return [max(1, round(1e12 * (named[q] if q in named else free * totals[q] / others))) for q in names]


def pack(tokens: DataFrame, window: int = 2048, group_windows: int = 1024, targets: Mapping[str | None, float] | None = None, max_queues: int = 4096) -> DataFrame:
    """Cut and place the documents of `tokens` (from `tokenised`, stored): one row per piece. `owed` is what the piece's queue is owed after the piece's window."""
    per_block = tokens.groupBy("block", "source").agg(F.sum("n").alias("tokens"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("block", "source", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    by_source = per_block.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    size, sources = per_block.agg(F.sum(F.octet_length("source") + 64), F.count_distinct("source")).first()
    placed = tokens.join(F.broadcast(starts) if (size or 0) <= FEW_STARTS else starts, ["block", "source"]).withColumn("x", F.col("base") + F.col("pos"))
    if sources > max_queues:
        own = ["" if k is None else f"={k}" for k in targets or {}]
        shared = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(max_queues)).cast("string"))
        queue = F.when(F.col("source").isin(own), F.col("source")).otherwise(shared) if own else shared
        phase = F.pmod(F.xxhash64("source", F.lit(1)), F.lit(1 << 20)) / (1 << 20)  # so that small sources don't all come at the same places
        rows = placed.join(by_source, "source").withColumns({"queue": queue, "far": (F.col("x") + phase * F.col("n")) / F.col("tokens")}).drop("x")
        rows = stored(rows.withColumn("slot", F.floor(F.col("far") * SLOTS).cast("int")).select("queue", "slot", "far", "source", "block", "pos", "doc_id", "n", "ids"), "packing-shared")
        per_slot = rows.groupBy("queue", "slot").agg(F.sum("n").alias("tokens"))
        ahead = Window.partitionBy("queue").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        bases = per_slot.select("queue", "slot", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("base"))
        within = Window.partitionBy("queue", "slot").orderBy("far", "source", "block", "pos").rowsBetween(Window.unboundedPreceding, -1)
        keys = rows.select("queue", "slot", "source", "block", "pos", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner"))
        keys = keys.join(bases, ["queue", "slot"]).select("source", "block", "pos", "queue", (F.col("base") + F.col("inner")).alias("x"))
        placed = rows.drop("queue").join(keys, ["source", "block", "pos"])
        per_queue = per_slot.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    else:
        placed, per_queue = placed.withColumn("queue", F.col("source")), by_source.withColumnRenamed("source", "queue")
    totals = {r["queue"]: r["tokens"] for r in per_queue.collect()}  # max_queues rows and the targets' at most
    names, weights, key = sorted(totals), weights_of(totals, targets), uuid.uuid4().hex
    amounts, number = [totals[q] for q in names], {q: k for k, q in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = _plan(key, amounts, weights, window, group_windows)
        for batch in slices(batches, 10_000):
            order = plan.order([number[q] for q in batch.column("queue").to_pylist()], batch.column("x").to_numpy())
            for first in range(0, len(order), 256):
                rows, out = batch.take(pa.array(order[first : first + 256])), []
                for doc, queue, x, n, raw in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "queue", "x", "n", "ids")), strict=True):
                    data = memoryview(np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                    for a, size, sequence, offset, owed in plan.pieces(number[queue], x, n):
                        out.append((doc, a, size, zlib.crc32(data[4 * a : 4 * (a + size)]), n, sequence, offset, queue, owed))
                columns = list(zip(*out, strict=True)) if out else [[]] * 9
                kinds = [*[pa.int64()] * 7, pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return placed.select("doc_id", "queue", "x", "n", "ids").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, group_windows: int = 1024, targets: Mapping[str | None, float] | None = None, max_queues: int = 4096, **columns) -> DataFrame:
    """Tokenise `docs`, store the ids in the shared folder, and pack them."""
    return pack(stored(tokenised(docs, tokenizer_path, **columns), "packing-ids"), window, group_windows, targets, max_queues)
