"""Masked pseudo-likelihood of texts by a bidirectional window network in numpy.

Words are predicted from `REACH` words on each side: the sum of place-dependent word vectors goes through tanh to a two-step softmax, first
over classes of words, then over the words of the class. A text's score is the sum of log P(word | both sides) over all its words.

1. Texts are dealt to shards by a hash of id and text, sorted there, and split into words once: a piece holds some two million words as numbers
   of its own word list, with the hashes of these words. What a piece holds thus depends on the documents alone, not on how the input was cut.
2. Every piece's word counts go to buckets by a hash of the word; a bucket adds them up over all documents and answers each piece.
   The `words` most frequent ones are predicted by the network as themselves. All others share `OTHERS` hashed places, and log P of such a word
   is that of its place plus log(its count / the count of its place), from these totals.
3. Training is data-parallel: in each round every piece starts from the common weights, goes over its words by Adagrad (in `rounds` rounds every
   word is a target once, all words are context), and the weights are averaged by the number of targets, in two levels.
4. Pieces meet the totals of their words and are scored.

Contracts: null and empty texts have no words: n_words 0, log_prob 0, mean null; very long texts are whole; repeated ids and rows are
scored each; null ids stay null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, slices, stored, text_or_empty
from .pretokens import chunks

REACH, HIDDEN, CLASSES, OTHERS = 2, 16, 40, 32
SHIFTS = [s for s in range(-REACH, REACH + 1) if s]
WORD = re.compile(r"\w+|[^\w\s]")
PARTS = 16
#: Characters of a shard, about, and words of a piece (a shard is one piece, but where single texts or repeated rows make it large).
SHARD_CHARS, PIECE_WORDS = 10_000_000, 4_000_000
#: Kinds of signs up to which texts are split by blanks put around signs.
MOST_SIGNS = 256
#: Weights stay within these bounds.
MOST = 8.0

PIECES = "piece long, doc_ids binary, known binary, lens binary, ids binary, words binary, counts binary, places binary"
ASKED = "bucket long, piece long, words binary, at binary, counts binary"
TOTALS = "bucket long, piece long, at binary, n binary, word string, total long"
SCORES = "doc_id long, n_words long, log_prob double, mean_log_prob double"


def _batch(spec: str, *rows: tuple) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    fields = [x.split() for x in spec.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


# ---- words


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^24 as three runs of bytes, of which the higher ones are mostly zeros and pack well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8).reshape(3, -1).astype(np.int64)
    return parts[0] | parts[1] << 8 | parts[2] << 16


_signs: dict[int, str | None] = {}


def signs_of(text: str) -> list[str]:
    """The distinct characters of `text` that are words by themselves: neither of words nor white space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
    seen[codes] = True
    out = []
    for c in np.flatnonzero(seen).tolist():
        if c not in _signs:
            _signs[c] = chr(c) if re.match(r"[^\w\s]", chr(c)) else None
        if _signs[c]:
            out.append(_signs[c])
    return out


def words_in(texts: list[str]) -> Iterator[list[str]]:
    """The words of each text, in lower case: what WORD finds. Blanks around signs leave the rest to `split`, which parts words where WORD has white space; where signs are of very many kinds, WORD finds them."""
    for a, b in chunks(texts, 1_000_000):
        lower = [t.lower() for t in texts[a:b]]
        joined = "\n".join([t.replace("\n", " ") for t in lower])
        signs = signs_of(joined)
        if len(signs) > MOST_SIGNS:
            yield from map(WORD.findall, lower)
            continue
        for sign in signs:
            joined = joined.replace(sign, f" {sign} ")
        yield from map(str.split, joined.split("\n"))


class _Piece:
    """Texts as numbers of the piece's own words."""

    def __init__(self):
        self.place: defaultdict[str, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self.ids = array("i")
        self.lens: list[int] = []
        self.docs: list[int | None] = []

    def add(self, doc: int | None, words: list[str]) -> None:
        self.ids.extend(map(self.place.__getitem__, words))
        self.lens.append(len(words))
        self.docs.append(doc)

    def full(self, most: int) -> bool:
        return len(self.ids) >= most or len(self.place) >= 1 << 23

    def row(self, number: int) -> tuple:
        ids, words = np.frombuffer(self.ids, np.int32), list(self.place)
        count = np.bincount(ids, minlength=len(words))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        known = np.array([d is not None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        words = [words[k] for k in order.tolist()]
        places = np.fromiter(map(place_of_word, words), "<u4", len(words))
        return number, docs.tobytes(), known.tobytes(), np.array(self.lens, "<u4").tobytes(), planes(rank[ids]), "\n".join(words).encode("utf-8", "surrogatepass"), count[order].astype("<u4").tobytes(), places.tobytes()


def words_of(raw: bytes) -> list[str]:
    return raw.decode("utf-8", "surrogatepass").split("\n") if raw else []


def pieces_of(docs: DataFrame, most: int = PIECE_WORDS) -> DataFrame:
    """Pieces of `docs` (doc_id, text); one ends with the text that brings it to `most` words."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece, number = _Piece(), TaskContext.get().partitionId() << 24
        for batch in slices(batches):
            for doc, words in zip(batch.column("doc_id").to_pylist(), words_in(batch.column("text").to_pylist()), strict=True):
                piece.add(doc, words)
                if piece.full(most):
                    yield _batch(PIECES, piece.row(number))
                    piece, number = _Piece(), number + 1
        if piece.docs:
            yield _batch(PIECES, piece.row(number))

    dealt = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    dealt = dealt.repartitionById(shards, F.pmod("key", F.lit(shards)).cast("int")).sortWithinPartitions("key", "doc_id")
    return dealt.select("doc_id", "text").mapInArrow(run, PIECES)


def place_of_word(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def word_totals(pieces: DataFrame, words: int) -> DataFrame:
    """Two kinds of rows: for a piece and bucket the totals (`n`) of the piece's words `at`; and the bucket's `words` most frequent words with their totals, beside its sum (no word)."""
    buckets = OTHERS * -(-8 * shuffle_width(pieces) // OTHERS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for r in batch.to_pylist():
                every, counts = words_of(r["words"]), np.frombuffer(r["counts"], "<u4")
                bucket = np.frombuffer(r["places"], "<u4").astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.unique(bucket).tolist():
                    at = order[cut[b] : cut[b + 1]]
                    yield _batch(ASKED, (b, r["piece"], "\n".join([every[k] for k in at.tolist()]).encode("utf-8", "surrogatepass"), at.astype("<u4").tobytes(), counts[at].tobytes()))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        place: defaultdict[str, int] = defaultdict()
        place.default_factory = place.__len__
        rows = [np.fromiter(map(place.__getitem__, words_of(raw)), np.int64) for raw in pdf["words"]]
        counts = [np.frombuffer(raw, "<u4") for raw in pdf["counts"]]
        total = np.bincount(np.concatenate(rows), np.concatenate(counts), minlength=len(place)).astype(np.int64)
        every = np.array(list(place), object)
        top = sorted(np.argsort(-total, kind="stable")[: 4 * words].tolist(), key=lambda k: (-total[k], every[k]))[:words]
        bucket, size = int(pdf["bucket"].iloc[0]), len(pdf)
        return pd.DataFrame({
            "bucket": [bucket] * (size + len(top) + 1), "piece": [*pdf["piece"].tolist(), *[-1] * (len(top) + 1)], "at": [*pdf["at"].tolist(), *[None] * (len(top) + 1)],
            "n": [*[total[r].astype("<i8").tobytes() for r in rows], *[None] * (len(top) + 1)], "word": [*[None] * size, *[every[k] for k in top], None],
            "total": [*[0] * size, *total[top].tolist(), int(total.sum())],
        })

    asked = pieces.select("piece", "words", "counts", "places").mapInArrow(ask, ASKED)
    return asked.groupBy("bucket").applyInPandas(answer, TOTALS)


class Vocabulary:
    """Ids: 0 the edge of a text, 1 to OTHERS hashed places of rare words, then the frequent words. Classes are runs of ids."""

    def __init__(self, counts: list[tuple[str, int]], rest: int):
        self.place = {w: 1 + OTHERS + k for k, (w, _) in enumerate(counts)}
        mass = np.sqrt(np.array([1.0, *[1.0 + rest / OTHERS] * OTHERS, *[n for _, n in counts]]))
        self.size = len(mass)
        kind = np.minimum((np.cumsum(mass) - mass) / mass.sum() * CLASSES, CLASSES - 1).astype(np.int64)
        self.kind = np.unique(kind, return_inverse=True)[1]
        self.edges = np.append(np.flatnonzero(np.diff(self.kind, prepend=-1)), self.size)
        self.short_kind = self.kind.astype(np.min_scalar_type(CLASSES))  # short numbers sort in fewer steps

    def ids(self, words: list[str], places: np.ndarray | None = None) -> np.ndarray:
        """The id of each word; `places` are their `place_of_word`, where these are known."""
        if places is None:
            places = np.fromiter(map(place_of_word, words), "<u4", len(words))
        found = np.fromiter(map(self.place.get, words, repeat(0)), np.int64, len(words))
        return np.where(found > 0, found, 1 + places.astype(np.int64) % OTHERS)

    def by_class(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The order of the places `at` by the class of their word."""
        return np.argsort(self.short_kind.take(ids.take(at)), kind="stable")


# ---- the network


def log_softmax_at(z: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each column the log softmax of its `row`; `z` is used up."""
    z -= z.max(0)
    own = z[row, np.arange(z.shape[1])]
    return own - np.log(np.exp(z, out=z).sum(0))


def softmax(z: np.ndarray) -> np.ndarray:
    """By column, in place."""
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


class Network:
    """tables: a vector for each place in the window and word; classes and words: the two softmax steps, with biases."""

    def __init__(self, vocab: Vocabulary, flat: np.ndarray | None = None):
        self.vocab = vocab
        n = len(vocab.edges) - 1
        self.shapes = [(2 * REACH, vocab.size, HIDDEN), (n, HIDDEN), (n,), (vocab.size, HIDDEN), (vocab.size,)]
        sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            flat = np.random.default_rng(11).standard_normal(sum(sizes)) * 0.1
        self.flat = flat.astype(np.float32).copy()
        cut = np.cumsum([0, *sizes])
        self.tables, self.classes, self.class_bias, self.words, self.word_bias = (self.flat[a:b].reshape(s) for a, b, s in zip(cut, cut[1:], self.shapes, strict=False))
        rows = self.tables.reshape(-1, HIDDEN), self.classes, self.class_bias[:, None], self.words, self.word_bias[:, None]
        self.rows = [(r, np.full((len(r), 1), 1e-6, np.float32)) for r in rows]  # a vector for each word or class, and Adagrad's sum of its mean squares

    def hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(HIDDEN, targets)."""
        x = self.tables[0].take(ids.take(at + SHIFTS[0]), axis=0)
        for k, shift in enumerate(SHIFTS[1:], 1):
            x += self.tables[k].take(ids.take(at + shift), axis=0)
        x = np.ascontiguousarray(x.T)
        return np.tanh(x, out=x)

    def _by_class(self, y: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(first word, end, first target, end) of each class of several words, for targets in the order of classes."""
        cut = np.searchsorted(self.vocab.kind[y], np.arange(len(self.vocab.edges))).tolist()
        edges = self.vocab.edges.tolist()
        return ((a, b, i, j) for a, b, i, j in zip(edges[:-1], edges[1:], cut[:-1], cut[1:], strict=True) if j > i and b - a > 1)

    def log_probs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(ids[at] | neighbours)."""
        order = self.vocab.by_class(ids, at)
        at = at[order]
        h, y = self.hidden(ids, at), ids[at]
        out = log_softmax_at(self.classes @ h + self.class_bias[:, None], self.vocab.kind[y])
        for a, b, i, j in self._by_class(y):
            out[i:j] += log_softmax_at(self.words[a:b] @ h[:, i:j] + self.word_bias[a:b, None], y[i:j] - a)
        back = np.empty_like(out)
        back[order] = out
        return back

    def gradients(self, ids: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the mean of -log P over the targets `at`, for each of `rows`: (the vectors' numbers, their gradients)."""
        at = at[self.vocab.by_class(ids, at)]
        h, y, n = self.hidden(ids, at), ids[at], len(at)
        p = softmax(self.classes @ h + self.class_bias[:, None])
        p[self.vocab.kind[y], np.arange(n)] -= 1
        back = self.classes.T @ p
        words, word_bias = np.zeros_like(self.words), np.zeros((len(self.words), 1), np.float32)
        for a, b, i, j in self._by_class(y):
            own = h[:, i:j]
            q = softmax(self.words[a:b] @ own + self.word_bias[a:b, None])
            q[y[i:j] - a, np.arange(j - i)] -= 1
            back[:, i:j] += self.words[a:b].T @ q
            words[a:b] = q @ own.T
            word_bias[a:b, 0] = q.sum(1)
        back *= 1 - h * h
        back = back.astype(np.float64)
        tables = np.empty((2 * REACH, self.vocab.size, HIDDEN), np.float32)
        for k, shift in enumerate(SHIFTS):
            seen = ids.take(at + shift)
            tables[k] = np.array([np.bincount(seen, of, self.vocab.size) for of in back]).T
        whole = slice(None)
        return [(whole, tables.reshape(-1, HIDDEN) / n), (whole, p @ h.T / n), (whole, p.sum(1)[:, None] / n), (whole, words / n), (whole, word_bias / n)]

    def step(self, ids: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One step of Adagrad, by vector, on the targets `at`."""
        for (row, total), (which, grad) in zip(self.rows, self.gradients(ids, at), strict=True):
            now = total[which] + np.einsum("ij,ij->i", grad, grad)[:, None] / grad.shape[1]
            total[which] = now
            row[which] -= (rate / np.sqrt(now)) * grad


def windows(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts with edges between, places of the words, and the text of each word."""
    owner = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(ids)) + REACH * (owner + 1)
    out = np.zeros(len(ids) + REACH * (len(lens) + 1), np.int64)
    out[at] = ids
    return out, at, owner


def targets(at: np.ndarray, owner: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """Of the words at `at`, those that round `number` trains: over all rounds, every word of every text once."""
    place = np.arange(len(at)) - np.searchsorted(owner, owner)
    return at[place % rounds == number]


def train_piece(net: Network, ids: np.ndarray, lens: np.ndarray, number: int, rounds: int, rate: float, batch_size: int) -> int:
    """Goes over one round's targets of a piece; their number."""
    ids, at, owner = windows(ids, lens)
    at = np.random.default_rng(len(at)).permutation(targets(at, owner, number, rounds))
    for k in range(0, len(at), batch_size):
        net.step(ids, at[k : k + batch_size], rate)
    np.clip(net.flat, -MOST, MOST, out=net.flat)
    return len(at)


# ---- training and scoring


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("task")
    total = sum(np.frombuffer(p, "<f8") for p in pdf["part"])
    return pd.DataFrame({"k": [pdf["k"].iloc[0]], "task": [pdf["task"].iloc[0]], "n": [int(pdf["n"].sum())], "part": [total.tobytes()]})


WEIGHTS = "k int, task int, n long, part binary"


def vocabulary(totals: DataFrame, words: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of the stored `totals`, and the sum of the rare words' counts by place."""
    top = [(r["word"], r["total"]) for r in totals.where(F.col("word").isNotNull()).orderBy(F.desc("total"), "word").limit(words).collect()]
    sums = totals.where("piece < 0 AND word IS NULL").groupBy((F.col("bucket") % OTHERS).alias("place")).agg(F.sum("total").alias("n")).collect()  # OTHERS rows
    place = np.zeros(OTHERS, np.int64)
    for r in sums:
        place[r["place"]] = r["n"]
    for w, n in top:
        place[place_of_word(w) % OTHERS] -= n
    return Vocabulary(top, int(place.sum())), place


def train(pieces: DataFrame, vocab: Vocabulary, rounds: int = 2, rate: float = 0.25, batch_size: int = 8192) -> Network:
    """Fit on all stored `pieces`."""
    spark, flat = pieces.sparkSession, Network(vocab).flat
    salt = max(1, round(pieces.count() ** 0.5))
    for number in range(rounds):
        cloud = spark.sparkContext.broadcast((vocab, flat))  # of a size that the parameters fix

        def run(batches: Iterator[pa.RecordBatch], cloud=cloud, number=number) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            vocab, start = cloud.value
            total, done = np.zeros(len(start)), 0
            for batch in slices(batches, 1):
                for r in batch.to_pylist():
                    net = Network(vocab, start)
                    n = train_piece(net, vocab.ids(words_of(r["words"]), np.frombuffer(r["places"], "<u4"))[from_planes(r["ids"])], np.frombuffer(r["lens"], "<u4").astype(np.int64), number, rounds, rate, batch_size)
                    total += n * net.flat.astype(np.float64)
                    done += n
            if done:
                task = TaskContext.get().partitionId()
                yield _batch(WEIGHTS, *[(k, task, done, p.astype("<f8").tobytes()) for k, p in enumerate(np.array_split(total, PARTS))])

        level = pieces.select("lens", "ids", "words", "places").mapInArrow(run, WEIGHTS).groupBy("k", F.pmod("task", F.lit(salt))).applyInPandas(_add_up, WEIGHTS)
        found = {r["k"]: (r["part"], r["n"]) for r in level.groupBy("k").applyInPandas(_add_up, WEIGHTS).collect()}  # one model
        if found:
            flat = (np.concatenate([np.frombuffer(found[k][0], "<f8") for k in range(PARTS)]) / found[0][1]).astype(np.float32)
        cloud.unpersist()
    return Network(vocab, flat)


def score(pieces: DataFrame, totals: DataFrame, net: Network, place: np.ndarray) -> DataFrame:
    """doc_id, n_words, log_prob and mean_log_prob of every document of the stored `pieces`; `place` is of `vocabulary`."""
    cloud = pieces.sparkSession.sparkContext.broadcast((net.vocab, net.flat, place))

    def run(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        vocab, flat, place = cloud.value
        net, r = Network(vocab, flat), own.iloc[0]
        words, lens = vocab.ids(words_of(r["words"]), np.frombuffer(r["places"], "<u4")), np.frombuffer(r["lens"], "<u4").astype(np.int64)
        count = np.zeros(len(words), np.int64)
        for at, n in zip(answers["at"], answers["n"], strict=True):
            count[np.frombuffer(at, "<u4")] = np.frombuffer(n, "<i8")
        rare = words <= OTHERS
        share = np.zeros(len(words))
        share[rare] = np.log(count[rare] / place[words[rare] - 1])
        local = from_planes(r["ids"])
        ids, at, owner = windows(words[local], lens)
        logs = np.concatenate([net.log_probs(ids, at[k : k + 16_384]) for k in range(0, len(at), 16_384)] or [np.zeros(0)]).astype(np.float64) + share[local]
        total = np.round(np.bincount(owner, logs, minlength=len(lens)), 4)
        doc_id = pd.Series(np.frombuffer(r["doc_ids"], "<i8")).astype("Int64").mask(np.frombuffer(r["known"], np.uint8) == 0)
        return pd.DataFrame({"doc_id": doc_id, "n_words": lens, "log_prob": total, "mean_log_prob": pd.Series(np.round(total / np.maximum(lens, 1), 6)).where(lens > 0)})

    answers = totals.where("piece >= 0").select("piece", "at", "n")
    return pieces.select("piece", "doc_ids", "known", "lens", "ids", "words", "places").groupBy("piece").cogroup(answers.groupBy("piece")).applyInPandas(run, SCORES)


def pseudo_likelihood(docs: DataFrame, words: int = 2000, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Train on `docs` and score them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    pieces = stored(pieces_of(rows), "lm-pieces")
    totals = stored(word_totals(pieces, words), "lm-totals")
    vocab, place = vocabulary(totals, words)
    return score(pieces, totals, train(pieces, vocab, **options), place)
