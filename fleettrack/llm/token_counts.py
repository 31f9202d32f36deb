"""Token counts by distinct pre-token: no ids are made for documents.

Blocks of documents are split into pre-tokens; each block gives, for every distinct pre-token, the documents that hold it and how often.
Every distinct pre-token of the corpus is encoded once by the tokenizer library, joined back to these frequencies, and summed by document.
Pre-tokens travel in buckets by their hash, so that a row holds many of them; a bucket's rows are joined by Spark, which can split large ones.

Contracts: null text counts as empty (0 tokens); special strings inside texts count as the library's default has them (one token);
empty, blank and very long texts need no special case; repeated doc_ids stay separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, slices, text_or_empty
from .pretokens import STOP, chunks, codes_of, distinct_pieces_of, library, starts_of, text_of

FREQUENCIES = "bucket long, block long, pieces binary, sizes binary, docs binary, counts binary, ordinals binary, doc_ids binary, bytes binary"
NAMES = [x.split()[0] for x in FREQUENCIES.split(", ")]
TYPES = [pa.int64(), pa.int64(), *[pa.binary()] * 7]


def joined(pieces: list[str]) -> bytes:
    """Strings as one value: each one's length in bytes, then all bytes."""
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    return np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw)


def parted(value: bytes) -> list[bytes]:
    n = int.from_bytes(value[:4], "little")
    ends = (np.cumsum(np.frombuffer(value, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [value[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


class _Block:
    """Frequencies of the pre-tokens of up to 65,536 documents."""

    def __init__(self, number: int, buckets: int):
        self.number, self.buckets, self.chars, self.docs = number, buckets, 0, 0
        self.place: dict[bytes, int] = {}
        self.pieces: list[str] = []
        self.found: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, texts: list[str]) -> None:
        codes = codes_of(texts)
        starts = starts_of(codes)
        code = codes[starts]
        stop = code == STOP
        owner = np.cumsum(stop) - stop + self.docs
        _, found, inverse = distinct_pieces_of(codes, starts)
        rows = np.fromiter(map(self.place.get, found, [-1] * len(found)), np.int64, len(found))
        new = np.flatnonzero(rows < 0)
        rows[new] = np.arange(len(self.pieces), len(self.pieces) + len(new))
        unseen = [found[k] for k in new.tolist()]
        self.pieces += map(text_of, unseen)
        self.place.update(zip(unseen, rows[new].tolist(), strict=True))
        keep = ~stop
        key, count = np.unique(rows[inverse[keep]] << 16 | owner[keep], return_counts=True)
        self.found.append(key)
        self.counts.append(count.astype(np.uint32))
        self.docs += len(texts)
        self.chars += len(codes)

    def by_bucket(self) -> Iterator[tuple[int, list[int]]]:
        """(bucket, its pieces' numbers)."""
        held: dict[int, list[int]] = {}
        for k, piece in enumerate(self.pieces):
            if piece:
                held.setdefault(zlib.crc32(piece.encode("utf-8", "surrogatepass")) % self.buckets, []).append(k)
        yield from held.items()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        self.place.clear()
        key, count = np.concatenate(self.found), np.concatenate(self.counts)
        self.found, self.counts = [], []
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        if (count > 255).any():  # a frequency over 255 is written as several entries
            times = -(-count.astype(np.int64) // 255)
            last = np.cumsum(times) - 1
            spread = np.full(int(times.sum()), 255, np.int64)
            spread[last] = count - (times - 1) * 255
            key, count = np.repeat(key, times), spread
        piece, doc = key >> 16, key & 0xFFFF
        edge = np.searchsorted(piece, np.arange(len(self.pieces) + 1))
        delta = np.diff(doc, prepend=0)
        at = edge[:-1][np.diff(edge) > 0]
        delta[at] = doc[at]
        delta, count = delta.astype("<u2"), count.astype(np.uint8)
        for bucket, which in self.by_bucket():
            n = edge[np.array(which) + 1] - edge[which]
            take = np.repeat(edge[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            d = delta[take]
            yield _row(bucket, self.number, joined([self.pieces[k] for k in which]), n.astype("<u4").tobytes(), np.concatenate([d & 0xFF, d >> 8]).astype(np.uint8).tobytes(), count[take].tobytes())


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*values, *[None] * (9 - len(values))], TYPES, strict=True)], names=NAMES)


def frequencies(docs: DataFrame, buckets: int, block_chars: int = 16_000_000) -> DataFrame:
    """Rows of two kinds for each block of documents: a bucket's pre-tokens with the documents that hold them, and the documents themselves (bucket below 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = _Block(TaskContext.get().partitionId() << 24, buckets)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            if block.docs + len(texts) > 60_000 or block.chars > block_chars:
                yield from block.rows()
                block = _Block(block.number + 1, buckets)
            ids = batch.column("doc_id")
            known = np.array([i is not None for i in ids.to_pylist()])
            yield _row(-1 - block.number, block.number, None, None, None, None, np.stack([np.arange(block.docs, block.docs + len(texts)), known]).astype("<i8").tobytes(), ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], "<i8").tobytes())
            for a, b in chunks(texts):
                block.add(texts[a:b])
        yield from block.rows()

    return docs.mapInArrow(run, FREQUENCIES)


def distinct_pieces(docs: DataFrame, buckets: int, chars: int = 16_000_000) -> DataFrame:
    """(bucket, pieces): pre-tokens of runs of documents, each once in a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: _Block) -> Iterator[pa.RecordBatch]:
            for bucket, which in block.by_bucket():
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([joined([block.pieces[k] for k in which])], pa.binary())], names=["bucket", "pieces"])

        block = _Block(0, buckets)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                block.add(texts[a:b])
            block.found, block.counts, block.docs = [], [], 0
            if block.chars > chars:
                yield from flush(block)
                block = _Block(0, buckets)
        yield from flush(block)

    return docs.select("text").mapInArrow(run, "bucket long, pieces binary")


def piece_sizes(pieces: DataFrame, tokenizer_path: str) -> DataFrame:
    """(bucket, known, tokens): each distinct pre-token of a bucket and its number of tokens by the tokenizer library."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        encode = library(tokenizer_path)
        words = sorted({p for value in pdf["pieces"] for p in parted(value)})
        sizes: list[int] = []
        for a in range(0, len(words), 4096):
            sizes += [len(x) for x in encode([w.decode("utf-8", "replace") for w in words[a : a + 4096]], add_special_tokens=False)]
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "known": [joined([w.decode("utf-8", "surrogatepass") for w in words])], "tokens": [np.array(sizes, "<u4").tobytes()]})

    return pieces.groupBy("bucket").applyInPandas(count, "bucket long, known binary, tokens binary")


SUMS = "block long, docs binary, tokens binary, ordinals binary, doc_ids binary, bytes binary"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens by block and document, added up over the rows of a task; emptied when 8 million documents are held."""
    names = [x.split()[0] for x in SUMS.split(", ")]
    types = [pa.int64(), *[pa.binary()] * 5]
    held: dict[int, np.ndarray] = {}

    def emit(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def flush():
        for block, sums in held.items():
            docs = np.flatnonzero(sums)
            yield emit(block, docs.astype("<u2").tobytes(), sums[docs].astype("<i8").tobytes(), None, None, None)
        held.clear()

    last: tuple[bytes, dict[bytes, int]] = (b"", {})
    for batch in slices(batches, 16):
        for r in batch.to_pylist():
            if r["ordinals"] is not None:
                yield emit(r["block"], None, None, r["ordinals"], r["doc_ids"], r["bytes"])
                continue
            if r["known"] != last[0]:
                last = (r["known"], dict(zip(parted(r["known"]), np.frombuffer(r["tokens"], "<u4").tolist(), strict=True)))
            size = np.array([last[1][p] for p in parted(r["pieces"])], np.int64)
            lens = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
            low, high = np.frombuffer(r["docs"], np.uint8).astype(np.int64).reshape(2, -1)
            total, ends = np.cumsum(low | high << 8), np.cumsum(lens)
            doc = total - np.repeat(np.concatenate([[0], total])[ends - lens], lens)
            sums = held.setdefault(r["block"], np.zeros(0, np.int64))
            add = np.bincount(doc, np.frombuffer(r["counts"], np.uint8) * np.repeat(size, lens)).astype(np.int64)
            if len(add) > len(sums):
                held[r["block"]] = sums = np.concatenate([sums, np.zeros(len(add) - len(sums), np.int64)])
            sums[: len(add)] += add
        if sum(map(len, held.values())) > 8_000_000:
            yield from flush()
    yield from flush()


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block with their sums."""
    part = pdf["docs"].notna()
    sums = np.zeros(1 << 16, np.int64)
    for d, t in zip(pdf.loc[part, "docs"], pdf.loc[part, "tokens"], strict=True):
        sums[np.frombuffer(d, "<u2")] += np.frombuffer(t, "<i8")
    both, ids, size = ([np.frombuffer(x, "<i8") for x in pdf.loc[~part, c]] for c in ("ordinals", "doc_ids", "bytes"))
    ordinal, known = (np.concatenate([x.reshape(2, -1)[k] for x in both]) for k in (0, 1))
    doc_id = pd.Series(np.concatenate(ids)).astype("Int64").mask(known == 0)
    return pd.DataFrame({"doc_id": doc_id, "n_bytes": np.concatenate(size), "n_tokens": sums[ordinal]})


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of `docs`. The texts are read twice; nothing is stored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    buckets = 8 * shuffle_width(docs, 32)
    sizes = piece_sizes(distinct_pieces(rows, buckets), tokenizer_path)
    sums = frequencies(rows, buckets).join(sizes, "bucket", "left").mapInArrow(_sums, SUMS)
    out = sums.groupBy("block").applyInPandas(_by_document, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
