"""Vectorised pre-tokenisation for the byte-level BPE vocabulary, and ids by pre-token from the tokenizer library.

The split is the one that the vocabulary file's ByteLevel step makes (its pattern is stated in the vocabulary package as PATTERN):
contractions, runs of letters, numbers or other signs with one leading blank, and white space. Here it is computed from
character classes with numpy over many texts at once; tests compare it with the tokenizer library.
"""

from __future__ import annotations

import os

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE, END, UNKNOWN = 0, 1, 2, 3, 4, 255
#: Code points past Unicode's last one: the end of a text, and a special string found in a text.
STOP, SPECIAL = 0x110000, 0x110001
SPECIAL_TEXT = "<|endoftext|>"

_classes = np.full(SPECIAL + 1, UNKNOWN, dtype=np.uint8)
_classes[[STOP, SPECIAL]] = END
_kinds = [(regex.compile(r"\p{L}"), LETTER), (regex.compile(r"\p{N}"), NUMBER), (regex.compile(r"\s"), SPACE)]
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def classes(codes: np.ndarray) -> np.ndarray:
    found = _classes[codes]
    if (found == UNKNOWN).any():
        for c in np.unique(codes[found == UNKNOWN]).tolist():
            _classes[c] = next((k for p, k in _kinds if p.match(chr(c))), OTHER) if not 0xD800 <= c < 0xE000 else OTHER
        found = _classes[codes]
    return found


def codes_of(texts: list[str]) -> np.ndarray:
    """Code points of all texts, with STOP behind each text and SPECIAL in place of each special string."""
    parts = []
    stop, special = np.array([STOP], dtype=np.uint32), np.array([SPECIAL], dtype=np.uint32)
    for text in texts:
        pieces = text.split(SPECIAL_TEXT) if SPECIAL_TEXT in text else (text,)
        for k, piece in enumerate(pieces):
            if k:
                parts.append(special)
            parts.append(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        parts.append(stop)
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def starts_of(codes: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token, STOP or SPECIAL starts."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    kind = classes(codes)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = END, kind[:-1]
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = END, kind[1:]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = codes[:-1] == 0x20
    space = kind == SPACE
    start = np.where(space, (before != SPACE) | (after <= OTHER), (before != kind) & ~after_blank)
    start[kind == END] = True
    for i in np.flatnonzero((codes == 0x27) & start).tolist():
        one, two = (int(codes[i + k]) if i + k < n else STOP for k in (1, 2))
        size = 2 if one < 128 and chr(one) in "stmd" else 3 if (one, two) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)) else 0
        if size:
            start[i + 1] = False
            if i + size < n and kind[i + size] == LETTER:
                start[i + size] = True
    return np.flatnonzero(start)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cached_powers = (_powers(1, _B), _powers(1, _B_INV))


def hashes_of(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece that does not depend on its place: prefix sums of a polynomial, shifted back to 0.

    Unlike pieces can share one (polynomials modulo a power of two do so for some words), so pieces are always compared behind it.
    """
    global _cached_powers
    n = len(codes)
    if len(_cached_powers[0]) < n:
        _cached_powers = (_powers(2 * n, _B), _powers(2 * n, _B_INV))
    x = codes.astype(np.uint64) + np.uint64(0x1234567)
    x ^= x >> np.uint64(7)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x |= np.uint64(1)
    x *= _cached_powers[0][:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    ends = np.append(starts[1:], n)
    return (total[ends] - total[starts]) * _cached_powers[1][starts]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte of `data` on, as one number each; zeros follow the last byte."""
    raw = data.tobytes() + bytes(8)
    return np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))


def low_bytes(n: np.ndarray) -> np.ndarray:
    """Masks of the lowest n bytes of a number, 0 to 8."""
    return np.where(n >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.uint64(8) * np.minimum(n, 7).astype(np.uint64))) - np.uint64(1))


def _alike(data: np.ndarray, start: np.ndarray, size: np.ndarray, start_2: np.ndarray, size_2: np.ndarray) -> bool:
    """Whether each run of `data` has the contents of its second run. Eight bytes at a time, and the long rest of long runs whole."""
    if not (size == size_2).all():
        return False
    width = data.itemsize
    left = np.flatnonzero(start != start_2)
    view, a, b, rest = eights(data), start[left] * width, start_2[left] * width, size[left] * width
    for _ in range(8):
        if not len(a):
            return True
        if ((view[a] ^ view[b]) & low_bytes(rest)).any():
            return False
        more = rest > 8
        a, b, rest = a[more] + 8, b[more] + 8, rest[more] - 8
    raw = data.view(np.uint8)
    return all((raw[x : x + n] == raw[y : y + n]).all() for x, y, n in zip(a.tolist(), b.tolist(), rest.tolist(), strict=True))


def distinct_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number): runs data[start:end] of the same contents have one number, and `first` has the first run of each number.

    Runs are grouped by `key`, which equal runs share, and compared with the first of their group. Where that finds unlike runs under one key,
    their contents are the keys.
    """
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    if _alike(data, start, end - start, start[first[number]], (end - start)[first[number]]):
        return first, number
    blob, width, place = data.tobytes(), data.itemsize, {}
    number = np.fromiter((place.setdefault(blob[a:b], len(place)) for a, b in zip((start * width).tolist(), (end * width).tolist(), strict=True)), np.int64, len(start))
    return np.unique(number, return_index=True)[1], number


def distinct_pieces_of(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(first, contents, number) of the distinct pieces of `codes`: where each one first starts, its code points, and the number of each piece's contents."""
    ends = np.append(starts[1:], len(codes))
    first, number = distinct_runs(codes, starts, ends, hashes_of(codes, starts))
    blob = codes.tobytes()
    return first, [blob[4 * a : 4 * b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], number


def text_of(piece: bytes) -> str:
    """The text of a piece's code points; STOP has none."""
    try:
        return piece.decode("utf-32-le")
    except UnicodeDecodeError:  # a code point past the last, or half a surrogate pair
        code = int.from_bytes(piece[:4], "little")
        return "" if code == STOP else SPECIAL_TEXT if code == SPECIAL else piece.decode("utf-32-le", "surrogatepass")


def _letters() -> np.ndarray:
    """The letter by which byte-level vocabularies write each byte: printable ones by themselves, the others from 256 on."""
    out = np.arange(256, dtype="<u4")
    hidden = np.array([b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b >= 174)])
    out[hidden] = 256 + np.arange(len(hidden))
    return out


_LETTERS = _letters()


def letters_of(pieces: list[bytes]) -> list[str]:
    """Each piece's UTF-8 bytes as letters of the vocabulary; STOP and SPECIAL have none, half a surrogate pair is a question mark."""
    codes = np.frombuffer(b"".join(pieces), "<u4")
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    half, mark = (codes >= 0xD800) & (codes < 0xE000), codes >= STOP
    width[half], width[mark] = 1, 0
    raw = np.where(half, np.uint32(0x3F), codes)[~mark].tobytes().decode("utf-32-le").encode()
    letters = _LETTERS[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")
    last = np.cumsum([len(p) >> 2 for p in pieces])
    ends = np.append(0, np.cumsum(width))[last].tolist()
    return [letters[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


_tokenizers: dict = {}


def _tokenizer(tokenizer_path: str):
    """The library's tokenizer for a vocabulary file, one for each process."""
    if tokenizer_path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[tokenizer_path] = Tokenizer.from_file(tokenizer_path)
    return _tokenizers[tokenizer_path]


def library(tokenizer_path: str):
    """encode_batch of the tokenizer library for a vocabulary file."""
    tokenizer = _tokenizer(tokenizer_path)
    return getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)


def model(tokenizer_path: str):
    """tokenize of the library's own merging model for a vocabulary file, which takes pieces in letters; None where the file has steps besides the split by bytes."""
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = _tokenizer(tokenizer_path)
    split = tokenizer.pre_tokenizer
    plain = tokenizer.normalizer is None and isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space
    return tokenizer.model.tokenize if plain else None


class PieceTable:
    """Pieces seen by this process, by their contents: their token counts and ids. When it holds `most` pieces, the half seen most often stays."""

    def __init__(self, tokenizer_path: str, most: int = 300_000):
        self.encode, self.merge = library(tokenizer_path), model(tokenizer_path)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool = np.empty(1 << 16, np.uint16)
        self.at = np.empty(1 << 15, np.int64)
        self.size = np.empty(1 << 15, np.int32)
        self.hits = np.zeros(1 << 15, np.int32)
        self.used = 0

    def shrink(self) -> None:
        n = len(self.place)
        cut = max(2, int(np.partition(self.hits[:n], n // 2)[n // 2]))
        stay = np.flatnonzero(self.hits[:n] >= cut)[: self.most // 2]
        number = np.full(n, -1)
        number[stay] = np.arange(len(stay))
        at, size, pool, hits = self.at[stay], self.size[stay], self.pool, self.hits[stay]
        place = {p: k for p, row in self.place.items() if (k := int(number[row])) >= 0}
        self.clear()
        ends = np.cumsum(size, dtype=np.int64)
        self.used = int(ends[-1]) if len(ends) else 0
        self.pool = pool[np.repeat(at - (ends - size), size) + np.arange(self.used)]
        self.at, self.size, self.hits, self.place = ends - size, size, hits // 2, place

    def ids(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        """(ids of all pieces in a row, number of ids of each piece) from the library: a text each, or in letters straight from its model, which spares most of the time of a short text."""
        found: list[int] = []
        sizes = []
        for a in range(0, len(pieces), 4096):
            part = pieces[a : a + 4096]
            if self.merge:
                for piece, letters in zip(part, letters_of(part), strict=True):
                    before = len(found)
                    if letters:
                        for x in self.merge(letters):
                            found.append(x.id)
                    else:
                        found.extend(self.encode([text_of(piece)], add_special_tokens=False)[0].ids)
                    sizes.append(len(found) - before)
                continue
            for x in self.encode([t if t.isascii() else t.encode("utf-8", "replace").decode() for t in map(text_of, part)], add_special_tokens=False):
                ids = x.ids
                found.extend(ids)
                sizes.append(len(ids))
        return found, sizes

    def rows(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each piece its row in `at` and `size`."""
        if len(self.place) > self.most:
            self.shrink()
        _, pieces, inverse = distinct_pieces_of(codes, starts)
        rows = np.fromiter(map(self.place.get, pieces, [-1] * len(pieces)), np.int64, len(pieces))
        new = np.flatnonzero(rows < 0)
        if len(new):
            unseen = [pieces[k] for k in new.tolist()]
            found, sizes = self.ids(unseen)
            k, rows_new = len(self.place), np.arange(len(self.place), len(self.place) + len(new))
            if self.used + len(found) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + 2 * len(found) + 1024, np.uint16)])
            if k + len(new) > len(self.at):
                self.at, self.size, self.hits = (np.concatenate([x[:k], np.zeros(k + 2 * len(new) + 1024, x.dtype)]) for x in (self.at, self.size, self.hits))
            self.hits[rows_new] = 0
            self.pool[self.used : self.used + len(found)] = found
            self.size[rows_new] = sizes
            self.at[rows_new] = self.used + np.cumsum(sizes) - sizes
            self.used += len(found)
            rows[new] = rows_new
            self.place.update(zip(unseen, rows_new.tolist(), strict=True))
        self.hits[rows] += 1
        return rows[inverse]


_tables: dict[str, PieceTable] = {}


def piece_table(tokenizer_path: str) -> PieceTable:
    """One table for each vocabulary and process; Spark's workers are reused, so it stays warm."""
    if tokenizer_path not in _tables:
        _tables[tokenizer_path] = PieceTable(tokenizer_path)
    return _tables[tokenizer_path]


def chunks(texts: list[str], chars: int = 500_000):
    """(first, last) index ranges of texts that hold about `chars` characters together."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def ids_of(texts: list[str], table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row (uint16), and the number of ids of each text."""
    codes = codes_of(texts)
    starts = starts_of(codes)
    rows = table.rows(codes, starts)
    sizes, at = table.size[rows], table.at[rows]
    ends = np.cumsum(sizes, dtype=np.int64)
    take = np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    stops = np.flatnonzero(codes[starts] == STOP)
    return table.pool[take], np.diff(ends[stops], prepend=0)
