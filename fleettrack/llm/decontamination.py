"""Benchmark decontamination by the q-gram lemma.

A passage within e edits of a benchmark item of m characters shares m - q + 1 - q*e q-grams with it, on diagonals no further apart than e.
Texts and items are compared in lower case with runs of white space as one blank. For every text, q-grams found in the items' index
are counted by item and by overlapping bands of diagonals (each 2e+1 wide or more, a step of e+1 apart, so that some band holds any
e+1 neighbouring diagonals). Bands that reach the bound are verified on the diagonals that their q-grams lie on and e more on each side: items
that stand there unchanged are found as they are, others by banded alignment. Places that overlap are one, with the least edits.

Contracts: null and empty texts and items match nothing; items shorter than `min_chars` match as whole words without edits;
repeated texts, items and ids are each reported; very long texts are whole; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

BITS = 22
WORD, JOINED = re.compile(r"\w+|[^\w\s]"), re.compile(r"\w\w")
_MULT = 0x9E3779B97F4A7C15


def normal(text: str) -> str:
    return " ".join(text.split()).lower()


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash for every q-gram of `codes`."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, size, factor = codes.astype(np.uint64), 1, _MULT
    while 2 * size <= q:  # twice the length in one step
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    for k in range(size, q):
        h = h[: len(codes) - k] * np.uint64(_MULT) + codes[k:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """Items by q-gram: sorted hashes with item and place, and a bitmap in front."""

    def __init__(self, items: list[tuple[int, str]], q: int, share: float, min_chars: int):
        named = [(i, normal(t)) for i, t in items]
        kept = [(i, codes_of(n), n) for i, n in named if len(n) >= min_chars]
        self.short: dict[str, list[int]] = {}
        self.lengths: dict[str, set[int]] = {}
        for i, n in named:
            if n and len(n) < min_chars:
                self.short.setdefault(n, []).append(i)
                self.lengths.setdefault(WORD.match(n)[0], set()).add(len(n))
        self.q = q
        self.ids, self.codes, self.texts = ([x[k] for x in kept] for k in range(3))
        self.edits = np.array([min(int(share * len(c)), (len(c) - q) // q) for c in self.codes], np.int64)
        self.bound = np.array([len(c) - q + 1 - q * e for c, e in zip(self.codes, self.edits.tolist(), strict=True)], np.int64)
        hashes = [grams(c, q) for c in self.codes]
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[(self.hash >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of the bands that reach the bound; neighbouring ones as one."""
        h = grams(codes, self.q)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(at):
            return []
        row = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        known = self.hash[row] == h[at]
        at, low, n = at[known], self.first[row[known]], self.count[row[known]]
        if not len(at):
            return []
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        item, diagonal = self.item[entry], np.repeat(at, n) - self.place[entry] + (1 << 20)
        enough = np.bincount(item, minlength=len(self.ids)) >= self.bound
        keep = enough[item]
        item, diagonal = item[keep], diagonal[keep]
        if not len(item):
            return []
        step = self.edits[item] + 1
        band = diagonal // step
        key = np.concatenate([item << 40 | band, item << 40 | (band - 1)])  # band b holds diagonals [b*step, (b+2)*step)
        order = np.argsort(key, kind="stable")
        key, diagonal = key[order], np.concatenate([diagonal, diagonal])[order] - (1 << 20)
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        hit = np.diff(np.append(edge, len(key))) >= self.bound[key[edge] >> 40]
        low, high = np.minimum.reduceat(diagonal, edge)[hit], np.maximum.reduceat(diagonal, edge)[hit]
        out: list[tuple[int, int, int]] = []
        before = (-1, 0)
        for k, first, last in zip(key[edge][hit].tolist(), low.tolist(), high.tolist(), strict=True):
            i, b = k >> 40, k & (1 << 40) - 1
            if before[0] == i and b <= before[1] + 2:  # the bands overlap or touch
                out[-1] = (i, min(first, out[-1][1]), max(last, out[-1][2]))
            else:
                out.append((i, first, last))
            before = (i, b)
        return out

    def _reached(self, text: np.ndarray, walls: np.ndarray, cost: np.ndarray, item: int) -> bool:
        """Whether a banded alignment stays within the budget. Costs are held less their column; a row with all of them above the budget ends it."""
        width, e = len(cost), int(self.edits[item])
        cols, walled = np.arange(width, dtype=np.int32), bool(walls.any())
        cost = cost - cols
        for i, letter in enumerate(self.codes[item]):
            new = cost + (text[i : i + width] != letter)
            if walled:
                new += walls[i : i + width]
            np.minimum(new[:-1], cost[1:] + 2, out=new[:-1])
            cost = np.minimum.accumulate(new)
            if i % 8 == 7 and (cost + cols).min() > e:
                return False
        return bool((cost + cols).min() <= e)

    def verify(self, text: str, codes: np.ndarray, item: int, first: int, last: int) -> list[tuple[int, int, int]]:
        """(edits, start, end) of the places of the item on the diagonals first - e to last + e, within the budget. Of places that overlap, the one of least edits, then the first, stays."""
        pattern, e = self.codes[item], int(self.edits[item])
        lo, m = first - e, len(pattern)
        if last - first + 3 * e < m:  # there is no room for two places
            at = text.find(self.texts[item], max(lo, 0), max(last + e + m, 0))
            if at >= 0:
                return [(0, at, at + m)]
        width = last + e - lo + 1
        big = m + width
        cols = np.arange(width, dtype=np.int32)
        cost = np.where((cols + lo >= 0) & (cols + lo <= len(codes)), 0, big).astype(np.int32)  # row 0: the item may start at any place
        near, walls = np.zeros(width + m, np.uint32), np.full(width + m, big, np.int32)
        a, b = max(lo, 0), min(lo + width + m, len(codes))
        near[a - lo : b - lo], walls[a - lo : b - lo] = codes[a:b], 0
        if not self._reached(near, walls, cost, item):
            return []
        start = cols + lo
        for i, letter in enumerate(pattern):
            diagonal = cost + (near[i : i + width] != letter) + walls[i : i + width]
            up, up_start = np.append(cost[1:] + 1, big), np.append(start[1:], 0)
            new = np.where(up < diagonal, up, diagonal)
            new_start = np.where(up < diagonal, up_start, start)
            run = np.minimum.accumulate(new - cols)  # characters of the text left out: a running minimum
            source = np.maximum.accumulate(np.where(new - cols == run, cols, -1))
            better = run + cols < new
            start = np.where(better, new_start[source], new_start)
            cost = np.where(better, run + cols, new)
        ends = np.flatnonzero(cost <= e)
        taken, out = np.zeros(width + m + 1, bool), []
        for k in ends[np.argsort(cost[ends], kind="stable")].tolist():
            x, y = int(start[k]) - lo, k + m
            if not taken[x:y].any():
                taken[x:y] = True
                out.append((int(cost[k]), x + lo, y + lo))
        return sorted(out, key=lambda place: place[1])

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) in the normal form of `text`."""
        text = normal(text)
        codes = codes_of(text)
        found = [(self.ids[i], x, y, n) for i, a, b in self.candidates(codes) for n, x, y in self.verify(text, codes, i, a, b)]
        return found + self.exact(text)

    def exact(self, text: str) -> list[tuple[int, int, int, int]]:
        """The short items that stand in the normal form `text` as whole words, one after the other."""
        out = []
        for m in WORD.finditer(text) if self.short else ():
            for n in self.lengths.get(m[0], ()):
                a, b = m.start(), m.start() + n
                if (own := self.short.get(text[a:b])) and not JOINED.match(text, b - 1):
                    out += [(i, a, b, 0) for i in own]
        return out


_held: dict[str, Index] = {}


def _index(key: str, items: list[tuple[int, str]], q: int, share: float, min_chars: int) -> Index:
    """The index of a block of items; a worker process keeps the last one for its next tasks."""
    if key not in _held:
        _held.clear()
        _held[key] = Index(items, q, share, min_chars)
    return _held[key]


FOUND = "doc_id long, item_id long, start long, end long, edits long"


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int):
    """Items in lists of about `block_chars` characters: what one broadcast holds is bounded by that."""
    block, held = [], 0
    for r in benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1])
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = 8, share: float = 0.1, min_chars: int = 50, block_chars: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each place where a document holds an item within share * length edits. A larger benchmark takes several passes."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    for block in _item_blocks(benchmark, item_col, item_text_col, block_chars):
        cloud, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], cloud=cloud, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(key, cloud.value, q, share, min_chars)
            for batch in slices(batches):
                found = [(d, *x) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in index.leaks(t)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 5)], names=["doc_id", "item_id", "start", "end", "edits"])

        part = rows.mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FOUND) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 8, share: float = 0.1, min_chars: int = 50, block_chars: int = 8_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns."""
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    for block in _item_blocks(benchmark, item_col, item_text_col, block_chars):
        cloud, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], cloud=cloud, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(key, cloud.value, q, share, min_chars)
            for batch in slices(batches):
                yield batch.filter(pa.array([not index.leaks(t or "") for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
