"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w.x - theta_k), with one weight vector for all ordered thresholds theta_1 < theta_2 < ...; the expected severity is
the sum of these probabilities over k. Features are the distinct words of a text and their leading 4, 5 and 6 letters, hashed; features
that speak for toxicity and such that speak against it are chosen by how far they are from independent of it.
The model is fitted in numpy on at most `max_rows` labelled documents (those with the smallest hash of their id; all of them count, and
each of n > 2 copies by 2/n: copies are known by their smallest 5-word shingle hash). Counts of features are summed by tasks; the driver gets
numbers by feature bucket (2^20 at most) and, for each of these documents, its chosen features.

Labels above 1 are grades themselves. Labels of 0 and 1 say toxic or not; grades above 0 are then made from them: toxic texts are ordered by how many
features they hold that are seen in toxic texts nearly alone, and cut into `levels` parts of about the same size. These features are found
in the half of the documents (by hash of id) to which the text does not belong.

Contracts: null and empty texts get severity of a text without features; rows with a null label or id are not used for fitting; a label table that
is empty or holds one class gives severity 0 for all; a label that repeats counts by its largest value, and of documents that repeat an id one
is used, that whose text has the smallest hash; extra columns of any name are carried by keep_harmless and ignored by score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 20


def features_of(word: str) -> set[int]:
    parts = {word} | {f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k}
    return {zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts}


@dataclass
class Ordinal:
    """weights by feature, thresholds in order."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; a row for each score."""
        t = np.asarray(self.thresholds)
        return 1 / (1 + np.exp(-np.clip(np.asarray(score)[:, None] - t[None, :], -40, 40)))


def copy_weights(keys: np.ndarray) -> np.ndarray:
    """2/n for each of n > 2 rows of one key, else 1. A key of -1 has no copies."""
    _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(keys == -1, 1.0, np.minimum(1.0, 2.0 / n[inverse]))


def telling(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Which features are seen in toxic texts nearly alone, from their (weighted) numbers of toxic and other texts."""
    return (bad >= 3) & (bad >= 20 * good)


def grades(toxic: np.ndarray, hits: np.ndarray, levels: int) -> np.ndarray:
    """0 for texts that are not toxic; toxic ones by the number of their telling features. Labels above 1 are grades already."""
    out = toxic.astype(np.int64)
    if out.max(initial=0) == 1:
        cuts = np.unique(np.quantile(hits[toxic == 1], np.arange(1, levels) / levels))
        out[toxic == 1] = 1 + np.searchsorted(cuts, hits[toxic == 1], "left")
    return np.unique(out, return_inverse=True)[1] if len(out) and out.min() == 0 else out  # without gaps


def choose(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float, most: int, against: float = 0.25) -> np.ndarray:
    """The features furthest from independent of toxicity: up to `most`, of which a share of `against` speaks against it."""
    both = bad + good
    share = both * n_bad / max(n_bad + n_good, 1e-9)
    chi = np.where(both >= 5, (bad - share) ** 2 / np.maximum(share, 1e-9) + (good - both + share) ** 2 / np.maximum(both - share, 1e-9), 0)
    out = []
    for side, n in ((bad * n_good > 3 * good * n_bad, most - int(against * most)), (good > both - share, int(against * most))):
        own = np.where(side & (chi > 10), chi, 0)
        found = np.argsort(-own, kind="stable")[:n]
        out.append(found[own[found] > 0])
    return np.sort(np.concatenate(out))


def fit(rows: list[np.ndarray], grade: np.ndarray, chosen: np.ndarray | None = None, weight: np.ndarray | None = None, most_features: int = 2048, l2: float = 5e-5, steps: int = 400, rate: float = 0.1) -> Ordinal:
    """Proportional-odds model by Adam on the weighted log-likelihood, on the features `chosen`."""
    if len(rows) == 0 or grade.min() == grade.max():
        return Ordinal()
    weight = np.ones(len(rows)) if weight is None else weight
    if chosen is None:
        bad, good = (np.bincount(np.concatenate([rows[k] for k in np.flatnonzero((grade > 0) == y)]), minlength=BUCKETS) for y in (True, False))
        chosen = choose(bad, good, int((grade > 0).sum()), int((grade == 0).sum()), most_features)
    if not len(chosen):
        return Ordinal()
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    cols = [place[r][place[r] >= 0] for r in rows]
    lens = np.array([len(c) for c in cols])
    col, row = np.concatenate(cols), np.repeat(np.arange(len(rows)), lens)
    top = int(grade.max())
    w, first, gaps = np.zeros(len(chosen)), np.zeros(1), np.zeros(max(0, top - 1))
    params = [w, first, gaps]
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    eye = (grade[:, None] == np.arange(top + 1)[None, :]).astype(float)
    class_weight = (1 / np.maximum(weight @ eye, 1e-9)) @ eye.T
    class_weight = class_weight * weight
    class_weight *= len(rows) / class_weight.sum()
    for step in range(1, steps + 1):
        theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        s = np.bincount(row, w[col], minlength=len(rows))
        g = 1 / (1 + np.exp(-np.clip(s[:, None] - theta[None, :], -40, 40)))  # P(y >= k)
        cum = np.concatenate([np.ones((len(rows), 1)), g, np.zeros((len(rows), 1))], 1)
        p = np.maximum((eye * (cum[:, :-1] - cum[:, 1:])).sum(1), 1e-9)
        d = np.concatenate([np.zeros((len(rows), 1)), g * (1 - g), np.zeros((len(rows), 1))], 1)
        slope = class_weight * (eye * (d[:, :-1] - d[:, 1:])).sum(1) / p / len(rows)  # d log p / d s
        dt = class_weight[:, None] / p[:, None] * (eye[:, :-1] * d[:, 1:-1] - eye[:, 1:] * d[:, 1:-1]) / len(rows)  # d log p / d theta
        dtheta = dt.sum(0)
        grads = [np.bincount(col, slope[row], minlength=len(w)) - l2 * w, np.array([dtheta.sum()]), np.array([dtheta[k + 1 :].sum() * np.exp(gaps[k]) for k in range(len(gaps))])]
        for k, grad in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            params[k] += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
    return Ordinal(dict(zip(chosen.tolist(), w.tolist(), strict=True)), theta.tolist())


def _copy_key(words: list[str]) -> int:
    """The smallest hash of five words in a row; -1 for texts with fewer."""
    return min((zlib.crc32(" ".join(words[k : k + 5]).encode("utf-8", "replace")) for k in range(len(words) - 4)), default=-1)


ROWS = "toxic long, half int, key long, features binary"
COUNTS = "half int, feature long, bad double, good double"
CHOSEN = "toxic long, key long, hits long, features binary"


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, set[int]] = {}
    for batch in slices(batches):
        out, keys = [], []
        for text in batch.column("text").to_pylist():
            found: set[int] = set()
            for word in set(WORD.findall(text.lower())):
                got = cache.get(word)
                if got is None:
                    got = cache[word] = features_of(word)
                found |= got
            out.append(np.array(sorted(found), "<u4").tobytes())
            keys.append(_copy_key(text.lower().split()))
            if len(cache) > 300_000:
                cache.clear()
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("half"), pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["toxic", "half", "key", "features"])


def _counts(feats: DataFrame, weight: dict[int, float]) -> DataFrame:
    """Weighted numbers of toxic and other rows by half and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, BUCKETS))
        for batch in batches:
            for toxic, half, key, raw in zip(*(batch.column(c).to_pylist() for c in ("toxic", "half", "key", "features")), strict=True):
                total[half, int(toxic > 0)][np.frombuffer(raw, "<u4")] += weight[key]
        half, feature = np.nonzero(total.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(half, pa.int32()), pa.array(feature), pa.array(total[half, 1, feature]), pa.array(total[half, 0, feature])], names=["half", "feature", "bad", "good"])

    return feats.mapInArrow(run, COUNTS).groupBy("half", "feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, levels: int = 3, most_features: int = 2048, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Ordinal:
    """Fit on at most `max_rows` labelled documents of `docs`."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("toxic")).where("toxic IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    ids = marks.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(ids), "id")  # max_rows rows
    texts = texts.groupBy("id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    half = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int")
    feats = stored(texts.select("toxic", half.alias("half"), "text").mapInArrow(_featurised, ROWS), "toxicity-features")
    seen = feats.select("toxic", "key").collect()  # max_rows rows of two numbers
    toxic = np.array([r["toxic"] > 0 for r in seen], bool)
    if not len(seen) or toxic.all() or not toxic.any():
        return Ordinal()
    keys = np.array([r["key"] for r in seen], np.int64)
    weights = copy_weights(keys)
    by_key = dict(zip(keys.tolist(), weights.tolist(), strict=True))
    table = _counts(feats, by_key).toArrow()  # two rows for each bucket at most
    count = np.zeros((2, 2, BUCKETS))
    for c, column in ((1, "bad"), (0, "good")):
        count[table["half"].to_numpy(), c, table["feature"].to_numpy()] = table[column].to_numpy()
    tell = np.stack([telling(*count[1 - h, ::-1]) for h in (0, 1)])  # of the other half
    chosen = choose(*count.sum(0)[::-1], weights[toxic].sum(), weights[~toxic].sum(), most_features)
    wanted = np.zeros(BUCKETS, bool)
    wanted[chosen] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, "<u4") for x in batch.column("features").to_pylist()]
            hits = [int(tell[h][x].sum()) for h, x in zip(batch.column("half").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("key"), pa.array(hits, pa.int64()), pa.array([x[wanted[x]].tobytes() for x in own], pa.binary())], names=["toxic", "key", "hits", "features"])

    rows = feats.mapInArrow(run, CHOSEN).orderBy("key", "toxic", "features").collect()  # max_rows rows of most_features numbers at most
    label, hits = np.array([r["toxic"] for r in rows], np.int64), np.array([r["hits"] for r in rows], np.int64)
    weight = np.array([by_key[r["key"]] for r in rows])
    return fit([np.frombuffer(r["features"], "<u4") for r in rows], grades(np.maximum(label, 0), hits, levels), chosen, weight)


class Scorer:
    """Scores texts; remembers words' features in this process."""

    def __init__(self, model: Ordinal, most_words: int = 400_000):
        self.model, self.most_words = model, most_words
        self.known: dict[str, tuple[int, ...]] = {}

    def p(self, texts: list[str]) -> np.ndarray:
        """P(grade >= k), a row for each text."""
        weights, known, scores = self.model.weights, self.known, []
        for text in texts:
            found: set[int] = set()
            for word in set(WORD.findall(text.lower())):
                got = known.get(word)
                if got is None:
                    got = known[word] = tuple(f for f in features_of(word) if f in weights)
                if got:
                    found.update(got)
            scores.append(sum(weights[f] for f in sorted(found)))
            if len(known) > self.most_words:
                known.clear()
        return self.model.probabilities(np.array(scores, float)) if self.model.thresholds else np.zeros((len(texts), 1))


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), p_toxic = P(grade >= 1) and the most probable grade, for every row."""
    cloud = docs.sparkSession.sparkContext.broadcast(model)  # 2048 weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(cloud.value)
        for batch in slices(batches):
            p = scorer.p(batch.column("text").to_pylist())
            full = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1)
            grade = np.argmax(full[:, :-1] - full[:, 1:], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(grade.astype(np.int64))], names=["doc_id", "severity", "p_toxic", "grade"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade long")


def keep_harmless(docs: DataFrame, model: Ordinal, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with P(grade >= 1) below `threshold`, with all their columns."""
    cloud = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(cloud.value)
        for batch in slices(batches):
            p = scorer.p([x or "" for x in batch.column(place).to_pylist()])[:, 0]
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
