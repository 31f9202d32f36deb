"""Sets of word shingles as 64-bit hashes, computed with numpy over many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

from .pretokens import eights, low_bytes

_WS = np.zeros(257, bool)
_WS[[0x20, *range(0x09, 0x0E), 256]] = True
_B = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are hashed many words at a time; longer ones are hashed one by one.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def run_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run: eight bytes at a time go through `mix`, which no combination of letters cancels out, begun with the run's size."""
    h = mix(size.astype(np.uint64) + _B)
    view, at, rest, row = eights(data), start, size, np.arange(len(start))
    row = row[size <= LONG]
    at, rest = at[row], rest[row]
    while len(row):
        h[row] = mix((h[row] ^ (view[at] & low_bytes(rest))) + _B)
        more = rest > 8
        row, at, rest = row[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : start[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word: bytes other than blanks and tab to carriage return, A-Z in lower case."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    lens = np.array([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    space = _WS[data]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    owner = np.searchsorted(np.cumsum(lens), start, "right")
    return run_hashes(data, start, end - start), owner


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text with fewer words has its whole sequence as one, one without words none."""
    if not texts:
        return []
    word, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    n = len(word) - size + 1
    if n > 0:
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * _B + word[k : k + n]
        h = mix(h)
        full = np.flatnonzero(owner[:n] == owner[size - 1 :])
        h, own = h[full], owner[full]
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own = h[new], own[new]
        cut = np.searchsorted(own, np.arange(len(texts) + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            out[k] = h[cut[k] : cut[k + 1]]
    for k in np.flatnonzero((count > 0) & (count < size)).tolist():
        h = np.uint64(count[k])
        with np.errstate(over="ignore"):
            for w in word[first[k] : first[k] + count[k]]:
                h = h * _B + w
        out[k] = mix(np.array([h ^ np.uint64(0xA5A5A5A5A5A5A5A5)], np.uint64))
    return out
