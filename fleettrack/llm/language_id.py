"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (made from the letter itself and a seed). An n-gram is bound from its letters' vectors, each
permuted (rotated) by its distance from the end, by multiplication; a text bundles (adds) its n-grams. A language's prototype bundles
its training texts, each at unit weight, less the mean prototype. Texts are compared with the prototypes by cosine.
Characters that are no letters count as one blank between words.

Contracts: null texts and texts without a letter give `und` with score 0; so does every text when nothing was learned; null languages
are not learned from; very long texts are whole; ties go to the first language in order; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty
from .pretokens import LETTER, STOP, classes

DIM, GRAM, SEED = 1024, 3, 7
BLANK = 0x20


def gram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, has_letter): for every n-gram of every text its text and its letters packed in 63 bits."""
    stop = np.array([STOP], np.uint32)
    codes = np.concatenate([x for t in texts for x in (np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32), stop)])
    kind = classes(codes)
    end = codes == STOP
    letter = kind == LETTER
    code = np.where(letter, codes, BLANK).astype(np.int64)
    owner = np.cumsum(end) - end
    has = np.bincount(owner[letter], minlength=len(texts))[: len(texts)] > 0
    keep = letter | np.concatenate([[True], letter[:-1]])  # a blank only behind a letter, and one in front of the text
    keep |= end
    code, owner = code[keep], owner[keep]
    lead = np.flatnonzero(np.diff(owner, prepend=-1))
    code, owner = np.insert(code, lead, BLANK), np.insert(owner, lead, owner[lead])
    same = owner[: 1 - GRAM] == owner[GRAM - 1 :]
    key = code[: 1 - GRAM] << 42 | code[1:-1] << 21 | code[2:]
    return owner[: 1 - GRAM][same], key[same], has


class Grams:
    """Vectors of n-grams, made when first asked for."""

    def __init__(self, most: int = 40_000):
        self.most, self.letters, self.place = most, {}, {}
        self.rows = np.empty((4096, DIM), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = (np.random.default_rng((SEED, c)).integers(0, 2, DIM, np.int8) * 2 - 1).astype(np.int8)
        return self.letters[c]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        if len(self.place) > self.most:
            self.place = {}
        at = []
        for k in keys.tolist():
            row = self.place.get(k)
            if row is None:
                row = self.place[k] = len(self.place)
                if row == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                a, b, c = (self.letter(x) for x in (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))
                self.rows[row] = np.roll(a, 2) * np.roll(b, 1) * c
            at.append(row)
        return self.rows[at].astype(np.float32)


def _runs(texts: list[str], chars: int = 150_000):
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t) + 1
        if held >= chars:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def bundles(texts: list[str], grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and whether it has a letter."""
    owner, key, has = gram_keys(texts)
    unique, inverse = np.unique(key, return_inverse=True)
    out = np.zeros((len(texts), DIM), np.float32)
    for a in range(0, len(unique), 8192):  # bounds the dense part for texts with very many distinct n-grams
        own = (inverse >= a) & (inverse < a + 8192)
        n = min(8192, len(unique) - a)
        counts = np.bincount(owner[own] * n + inverse[own] - a, minlength=len(texts) * n).reshape(len(texts), n).astype(np.float32)
        out += counts @ grams.vectors(unique[a : a + n])
    return out, has


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Unit prototypes by language, from all rows of `docs` with a language and a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(), {}
        for batch in slices(batches):
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for a, b in _runs(texts):
                x, has = bundles(texts[a:b], grams)
                x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None] * has[:, None]
                for lang in set(langs[a:b]):
                    sums[lang] = sums.get(lang, 0.0) + x[langs[a:b] == lang].sum(0, dtype=np.float64)
        for lang, v in sorted(sums.items()):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(range(DIM), pa.int32()), pa.array(v)], names=["lang", "d", "v"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(run, "lang string, d int, v double").groupBy("lang", "d").agg(F.sum("v").alias("v")).collect()  # DIM rows for each language
    found: dict[str, np.ndarray] = {}
    for r in sums:
        found.setdefault(r["lang"], np.zeros(DIM))[r["d"]] = r["v"]
    unit = {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if np.linalg.norm(v) > 0}
    if len(unit) > 1:
        mean = np.mean(list(unit.values()), 0)
        unit = {k: (v - mean) / max(np.linalg.norm(v - mean), 1e-12) for k, v in unit.items()}
    return unit


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (cosine, 0 at least) of every row; only the text is looked at."""
    names = list(prototypes)
    table = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIM).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            langs, scores = [], []
            for a, b in _runs(texts):
                x, has = bundles(texts[a:b], grams)
                cos = x @ table / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None] if names else np.zeros((b - a, 1))
                best = np.argmax(cos, 1)
                langs += [names[k] if h and names else "und" for k, h in zip(best.tolist(), has.tolist(), strict=True)]
                scores.append(np.where(has, np.clip(cos[np.arange(b - a), best], 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]).astype(np.float64))], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out_rows(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id's text has the remainder 2 by 4; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
