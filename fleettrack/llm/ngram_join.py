"""Exact Jaccard join of documents on word n-gram sets, by prefix trees.

1. Blocks of documents send their distinct shingles, with the number of documents that hold them, to buckets by hash; a bucket adds them up and
   answers each block. So every document learns how often each of its shingles occurs in the corpus. Shingles that occur once
   can't be shared: a document of n shingles with fewer than the overlap that a link takes (share * n) shared ones is done.
2. Equal sets are one class. Classes order their shared shingles by rising frequency, the same order everywhere; two that link hold a common
   shingle within their prefixes. Classes that such shingles connect are a family; families are joined on their own.
3. A family's ordered sets are stored in a trie whose edges hold runs of shingles. Each set walks down it: sets with a common beginning share
   the overlap counted so far, and a subtree is left when its size bounds or the remaining lengths rule out a link, or when all it holds
   is already connected with the walker. Large families are cut into blocks: joined by themselves, then with the pivots of the
   largest components, and last every set outside the family's largest component with every block.

Contracts: null texts and texts without words have an empty set and link with nothing; repeated doc_ids are one node, and null ones
are not linked (their component is null); rows are all returned; very long texts are whole; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, place_of, same_order, shuffle_width, slices, stored, text_or_empty
from .components import components
from .pretokens import chunks
from .shingles import shingle_sets

PART = "bucket long, block long, hashes binary, counts binary"
ANSWER = "block long, bucket long, codes binary, hashes binary, total long"
OWN = "block long, bucket long, codes binary, hashes binary, total long, docs binary, ids binary, sizes binary, sigs binary, index binary"
OWN_NAMES = [x.split()[0] for x in OWN.split(", ")]
SETS = "doc_id long, n long, sig binary, tokens binary"
#: Bits of a shingle's hash that its key holds, below its frequency.
KEY_BITS = 56
FAMILY = 512


class _Block:
    """Distinct shingle sets of a run of documents."""

    def __init__(self, number: int):
        self.number, self.held = number, 0
        self.docs: list[tuple[int | None, int, bytes]] = []
        self.place: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []

    def add(self, doc: int | None, found: np.ndarray) -> None:
        sig = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else b""
        self.docs.append((doc, len(found), sig))
        if sig and sig not in self.place:
            self.place[sig] = len(self.sets)
            self.sets.append(found)
            self.held += len(found)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        every = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        return np.unique(every, return_inverse=True, return_counts=True)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[_Block]:
    from pyspark import TaskContext

    block = _Block(TaskContext.get().partitionId() << 24)
    for batch in slices(batches):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in chunks(texts):
            for doc, found in zip(ids[a:b], shingle_sets(texts[a:b], size), strict=True):
                block.add(doc, found)
            if block.held > most or len(block.docs) > 60_000:
                yield block
                block = _Block(block.number + 1)
    if block.docs:
        yield block


def _cut(distinct: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) over sorted hashes; a bucket is their first `bits` bits."""
    bucket = (distinct >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(at[1:], len(bucket))[: len(at)]  # without hashes there is no bucket
    return list(zip(bucket[at].tolist(), at.tolist(), ends.tolist(), strict=True))


def _width(bits: int) -> int:
    """Bytes behind a bucket's bits that complete KEY_BITS."""
    return -(-(KEY_BITS - bits) // 8)


def _low(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Of each hash the bytes behind its bucket's bits, as a number."""
    return (distinct << np.uint64(bits)) >> np.uint64(64 - 8 * _width(bits))


def _packed(numbers: np.ndarray, width: int) -> bytes:
    """The last `width` bytes of numbers, as steps from one to the next: all first bytes, then all second ones. Where numbers mostly rise, high bytes are mostly zero and shrink in a shuffle."""
    step = np.diff(numbers.astype("<u8"), prepend=np.uint64(0))
    return step.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    """What `_packed` was given."""
    step = np.zeros((len(raw) // width, 8), np.uint8)
    step[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) & np.uint64((1 << 8 * width) - 1)


def _frequencies(bits: int):
    width = _width(bits)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The answer of one bucket to its blocks: a code that rises with a hash's number of documents (0: one), the hashes that have more, and the sum of all that were asked for."""
        lens = np.array([len(x) // width for x in pdf["hashes"]])
        h = np.concatenate([_unpacked(x, width) for x in pdf["hashes"]])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["counts"]])
        _, inverse = np.unique(h, return_inverse=True)
        code = np.minimum(255, np.rint(12 * np.log2(np.bincount(inverse, n)))).astype(np.uint8)[inverse]
        ends = np.cumsum(lens)
        codes = [code[b - k : b] for b, k in zip(ends, lens, strict=True)]
        hashes = [_packed(h[b - k : b][c > 0], width) for b, k, c in zip(ends, lens, codes, strict=True)]
        total = [int(h[b - k : b].sum(dtype=np.uint64).astype(np.int64)) for b, k in zip(ends, lens, strict=True)]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "codes": [c.tobytes() for c in codes], "hashes": hashes, "total": total})

    return run


def _shared(share: int, bits: int):
    width = _width(bits)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One block's documents; those that may link have their shared shingles in order, as 64-bit keys: frequency code, then KEY_BITS of the hash."""
        answers = pdf[pdf["docs"].isna()].sort_values("bucket")
        own = pdf[pdf["docs"].notna()].iloc[0]
        known, ids = np.frombuffer(own["docs"], np.uint8).astype(bool), np.frombuffer(own["ids"], "<i8")
        sizes = np.frombuffer(own["sizes"], "<u4").astype(np.int64)
        sigs = [own["sigs"][k : k + 16] for k in range(0, 16 * len(ids), 16)]
        code = np.frombuffer(b"".join(answers["codes"]), np.uint8)
        low = np.concatenate([np.empty(0, np.uint64), *(_unpacked(x, width) for x in answers["hashes"])])
        bucket = np.repeat(answers["bucket"].to_numpy(np.uint64), [len(x) // width for x in answers["hashes"]])
        key = np.zeros(len(code), np.uint64)
        known_hash = (bucket << np.uint64(8 * width) | low) >> np.uint64(bits + 8 * width - KEY_BITS)
        key[code > 0] = code[code > 0].astype(np.uint64) << np.uint64(KEY_BITS) | known_hash
        index = _unpacked(own["index"], 4).astype(np.int64)
        asked = int(answers["total"].to_numpy(np.int64).view(np.uint64).sum(dtype=np.uint64).astype(np.int64))
        if asked != own["total"]:
            raise RuntimeError("the documents came in another order when they were read again: store them first")
        keys = key[index]
        tokens: list[bytes | None] = []
        at, done = 0, set()
        for n, sig in zip(sizes.tolist(), sigs, strict=True):
            if not n or sig in done:
                tokens.append(None)
                continue
            done.add(sig)
            mine = keys[at : at + n]
            at += n
            mine = mine[mine > 0]
            tokens.append(np.sort(mine).astype("<u8").tobytes() if 100 * len(mine) >= share * n else None)
        doc_id = pd.Series(ids).astype("Int64").mask(~known)
        return pd.DataFrame({"doc_id": doc_id, "n": sizes, "sig": [s if n else None for s, n in zip(sigs, sizes.tolist(), strict=True)], "tokens": tokens})

    return run


def shared_sets(docs: DataFrame, size: int, share: int, most: int = 1_500_000) -> DataFrame:
    """doc_id, n (set size), sig (of the set), and tokens for one document of each set and block that may link."""
    bits = min(24, max(8, (8 * shuffle_width(docs) - 1).bit_length()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, size, most):
            distinct, _, count = block.distinct()
            count = np.minimum(count, 255).astype(np.uint8)
            for bucket, a, b in _cut(distinct, bits):
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([block.number]), pa.array([_packed(_low(distinct[a:b], bits), _width(bits))]), pa.array([count[a:b].tobytes()])], names=["bucket", "block", "hashes", "counts"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, size, most):
            distinct, inverse, _ = block.distinct()
            total = int(_low(distinct, bits).sum(dtype=np.uint64).astype(np.int64))
            ids, sizes, sigs = zip(*block.docs, strict=True)
            values = [block.number, None, None, None, total, np.array([i is not None for i in ids], np.uint8).tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), b"".join(s.ljust(16, b"\0") for s in sigs), _packed(inverse, 4)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), *[pa.binary()] * 5], strict=True)], names=OWN_NAMES)

    answers = docs.mapInArrow(ask, PART).groupBy("bucket").applyInPandas(_frequencies(bits), ANSWER)
    both = docs.mapInArrow(own, OWN).unionByName(answers, allowMissingColumns=True)
    return both.groupBy("block").applyInPandas(_shared(share, bits), SETS)


class Trie:
    """Ordered sets; a node is [edge, children, ends, first, last, least n, largest n, longest length]; ends are sets that end there."""

    def __init__(self, sets: list[list[int]], sizes: list[int]):
        self.order = sorted(range(len(sets)), key=sets.__getitem__)
        self.sets, self.sizes = [sets[k] for k in self.order], [sizes[k] for k in self.order]
        self.root = self._node(0, len(sets), 0)
        todo = [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            a, b = node[3], node[4]
            end = depth + len(node[0])
            while a < b and len(self.sets[a]) == end:
                node[2].append(a)
                a += 1
            while a < b:
                token, c = self.sets[a][end], a + 1
                while c < b and self.sets[c][end] == token:
                    c += 1
                child = self._node(a, c, end)
                node[1].append(child)
                todo.append((child, end))
                a = c

    def _node(self, a: int, b: int, depth: int) -> list:
        edge: list[int] = []
        if a < b:
            low, high = self.sets[a], self.sets[b - 1]
            k, most = depth, min(len(low), len(high))
            while k < most and low[k] == high[k]:
                k += 1
            edge = low[depth:k]
        sizes = self.sizes[a:b]
        return [edge, [], [], a, b, min(sizes, default=0), max(sizes, default=0), max(map(len, self.sets[a:b]), default=0)]

    def links(self, tokens: list[int], n: int, group: np.ndarray, own: int, share: int) -> Iterator[int]:
        """Places (in trie order) of sets outside group `own` that link with the walker. Regroup between two results as you like."""
        at = {t: k for k, t in enumerate(tokens)}
        size, whole = len(tokens), 100 + share
        todo = [(self.root, 0, 0, 0)]
        while todo:
            node, overlap, used, depth = todo.pop()
            edge, children, ends, a, b, low, high, longest = node
            if 100 * high < share * n or 100 * n < share * low or (group[a:b] == group[own]).all():
                continue
            need = -(-share * (n + low) // whole)  # the least overlap of any set below
            for k, t in enumerate(edge):
                p = at.get(t)
                if p is None:
                    if overlap + longest - depth - k - 1 < need:
                        break
                else:
                    overlap += 1
                    used = p + 1
            else:
                depth += len(edge)
                if overlap + min(size - used, longest - depth) < need:
                    continue
                for y in ends:
                    if group[y] != group[own] and whole * overlap >= share * (n + self.sizes[y]):
                        yield y
                todo += [(c, overlap, used, depth) for c in children]


def _trie_join(share: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Joins the walkers (role 1) and the held sets (role 0 or 2) of one group; 2 is both. Gives links that connect what was not connected."""
        sets = [np.frombuffer(t, "<u8").tolist() for t in pdf["tokens"]]
        role, n, node, comp = (pdf[c].tolist() for c in ("role", "n", "node", "comp"))
        held = [k for k, r in enumerate(role) if r != 1]
        trie = Trie([sets[k] for k in held], [n[k] for k in held])
        rows = [held[k] for k in trie.order] + [k for k, r in enumerate(role) if r == 1]  # trie order, then walkers
        _, group = np.unique([comp[k] for k in rows], return_inverse=True)
        out = []
        for me, k in enumerate(rows):
            if role[k] != 0:
                for y in trie.links(sets[k], n[k], group, me, share):
                    out.append((node[k], node[rows[y]]))
                    group[group == group[y]] = group[me]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` (node, comp, ...) with comp lowered by `edges` between nodes: components over the components."""
    label = nodes.select("node", "comp")
    ends = edges.join(label.withColumnRenamed("node", "a").withColumnRenamed("comp", "ca"), "a").join(label.withColumnRenamed("node", "b").withColumnRenamed("comp", "cb"), "b")
    found = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), "component")
    return nodes.join(found, "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")


def jaccard_components(docs: DataFrame, size: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`; links have Jaccard >= share / 100."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    twice = []
    if not same_order(rows):  # blocks are made in two readings, which have to cut alike
        rows = stored(rows, "shingle-rows")
        twice = [place_of(rows)]
    sets = stored(shared_sets(rows, size, share), "shingle-sets")
    sets_place = place_of(sets)
    delete(docs.sparkSession, twice)
    classes = stored(sets.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("node")), "shingle-classes")
    held = sets.where(F.col("tokens").isNotNull()).groupBy("sig").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    held = stored(held.join(classes.where(F.col("node").isNotNull()), "sig").select("node", "sig", "n", "tokens"), "shingle-held")
    held_place = place_of(held)
    sets = stored(sets.select("doc_id", "n", "sig"), "shingle-sizes")  # the tokens go on in `held` alone
    delete(docs.sparkSession, [sets_place])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, node = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k, n, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "tokens")), strict=True):
                own = np.frombuffer(raw, "<u8")
                token.append(own[: len(own) + 1 - -(-share * n // 100)].view(np.int64))
                node.append(np.full(len(token[-1]), k, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.concatenate(node))], names=["token", "node"])

    prefix = held.mapInArrow(prefixes, "token long, node long")
    least = stored(prefix.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token", "low"), "prefix-least")
    families = components(prefix.join(least, "token").where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")))
    families = families.withColumnRenamed("component", "family")
    counts = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / FAMILY).cast("int").alias("blocks"))
    counts = stored(counts, "family-sizes")
    placed = held.join(families, "node").join(counts, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    now = stored(placed.select("node", "n", "tokens", "family", "blocks", "block", F.col("node").alias("comp")), "families")
    now_place = place_of(now)
    delete(docs.sparkSession, [held_place])
    walk = _trie_join(share)
    wide = ["family", "block", "node", "comp", "n", "tokens"]
    links = now.select(*wide, F.lit(2).alias("role")).groupBy("family", "block").applyInPandas(walk, "a long, b long")
    label = stored(_connected(now.select("node", "comp"), links), "family-links")
    large = now.where("blocks > 1").drop("comp")
    if large.limit(1).count():
        for step in ("pivots", "rest"):
            here = large.join(label, "node")
            sizes = here.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("members"))
            rank = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("members"), "comp"))
            if step == "pivots":
                chosen = sizes.withColumn("k", rank).where("k <= 32").select(F.col("comp").alias("node"))
                walkers = here.join(chosen, "node", "left_semi")  # a component's id is one of its members
            else:
                largest = sizes.groupBy("family").agg(F.max(F.struct("members", F.negate("comp").alias("c"))).alias("m")).select("family", F.negate(F.col("m.c")).alias("top"))
                walkers = here.join(stored(largest, "largest"), "family").where("comp != top")
            salted = walkers.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)))
            chunk = walkers.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / FAMILY).cast("int").alias("parts"))
            chunk = stored(chunk, "walker-parts")
            walkers = salted.join(chunk, "family").withColumn("part", (F.col("part") % F.col("parts")).cast("int"))
            walkers = walkers.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            held_here = here.join(chunk, "family").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            both = walkers.select(*wide, "part", F.lit(1).alias("role")).unionByName(held_here.select(*wide, "part", F.lit(0).alias("role")))
            links = both.groupBy("family", "block", "part").applyInPandas(walk, "a long, b long")
            label = stored(_connected(label, links), "family-links")
    delete(docs.sparkSession, [now_place])
    comp = label.select("node", "comp")
    whole = classes.join(comp, "node", "left").select("sig", F.coalesce("comp", "node").alias("component_id"))
    out = sets.select("doc_id", "n", "sig").join(whole, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
