"""Vectorised scanning of UTF-8 texts: words, 64-bit word hashes, shingle hashes.

Words are maximal runs of bytes other than space and 0x09-0x0D, so every array is
computed on the raw buffer of an Arrow batch without decoding a string. A byte range
is hashed eight bytes at a time: each step is one-to-one in the state and in the
eight bytes, so ranges that differ in one step never meet by structure, only by
chance; ranges beyond `LONG` bytes go through BLAKE2b. Equal ranges hash alike in
every process and run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import binary, give_back

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: The first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Ranges of more bytes than this are hashed by BLAKE2b.
LONG = 256
#: Bytes scanned at once; the arrays take some 60 bytes for each.
SLICE = 512 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of data on as a number; zeros stand behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each byte range."""
    view, size = eights(data), end - start
    out = size.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(0xD1B54A32D192ED03)
    rows, at, left = None, start, size
    large = size > LONG
    if large.any():
        rows = np.flatnonzero(~large)
        at, left = start[rows], size[rows]
    while len(at):
        x = (out if rows is None else out[rows]) ^ (view[at] & _FIRST[np.minimum(left, 8)])
        x *= _U(0x9FB21C651E98DF25)
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(29)
        if rows is None:
            out = x
        else:
            out[rows] = x
        more = left > 8
        rows = np.flatnonzero(more) if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    out = mix(out)
    for k in np.flatnonzero(large).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


@dataclass
class Scan:
    """Some whole texts. bounds: byte range of each in data; first: word range of each in the arrays of words; hashed: data as the hashes see it."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashed: np.ndarray
    hashes: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """The count of set byte flags in each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every k-word window; windows stay inside a text."""
        h = self.hashes
        if len(h) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = len(h) - k + 1
        x = h[:n].copy()
        for i in range(1, k):
            x *= _U(0xD6E8FEB86659FD93)
            x += h[i : i + n]
            x ^= x >> _U(29)
        ends = np.repeat(self.first[1:], self.n_words)[:n]
        at = np.flatnonzero(np.arange(k, n + k) <= ends)
        return at, mix(x[at])

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1


def scan(data: np.ndarray, bounds: np.ndarray, fold: bool = False) -> Scan:
    inside = ~SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    if n:
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    else:
        start = end = np.zeros(0, np.int64)
    hashed = _FOLD[data] if fold else data
    return Scan(data, bounds, start, end, np.searchsorted(start, bounds), hashed, range_hash(hashed, start, end))


def slices(column: pa.ChunkedArray | pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, bounds) of consecutive whole texts of about size bytes together; nulls count as empty."""
    column = binary(column)
    if not len(column):
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi, values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    give_back()


def scans(column: pa.ChunkedArray | pa.Array, fold: bool = False) -> Iterator[tuple[int, int, Scan]]:
    for lo, hi, data, bounds in slices(column):
        yield lo, hi, scan(data, bounds, fold)


class RunTable:
    """Maps 64-bit keys to runs of numbers or bytes, looked up and laid out for whole arrays of keys.

    Emptied when it holds `most` keys, which bounds memory and changes no result: a
    batch's missing keys are added after that, whatever their number.
    """

    def __init__(self, dtype, most: int = 3_000_000):
        self.dtype, self.most = np.dtype(dtype), most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.data, self.used = np.zeros(1 << 16, self.dtype), 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Mask of sorted distinct keys that the table lacks; to be added before the next find()."""
        if len(self.keys) >= self.most:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return ~known

    def add(self, keys: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
        """New keys, sorted, and their runs one after the other in data."""
        while self.used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(len(self.data), self.dtype)])
        self.data[self.used : self.used + len(data)] = data
        lengths = np.asarray(lengths, np.int64)
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(data)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.length = np.insert(self.keys, at, keys), np.insert(self.start, at, starts), np.insert(self.length, at, lengths)

    def find(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)

    def lay_out(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of the found rows one after the other, and their lengths."""
        lengths = self.length[rows]
        before = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        return self.data[np.repeat(self.start[rows] - before, lengths) + np.arange(total)], lengths


def parts(s: Scan, closing: np.ndarray, special: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, key, parts before each text): words, cut where closing punctuation follows an ASCII letter or digit.

    Keys are the scan's hashes, so they ignore case where it does; a part that contains
    one of the special beginnings is hashed as it stands.
    """
    last = np.where(closing[s.data], -1, np.arange(len(s.data)))
    np.maximum.accumulate(last, out=last)
    before = last[s.end - 1] if len(s.end) else last[:0]
    stem = s.data[np.maximum(before, 0)] if len(s.data) else s.data[:0]
    alnum = ((stem >= 48) & (stem <= 57)) | ((stem >= 65) & (stem <= 90)) | ((stem >= 97) & (stem <= 122))
    cut = (before >= s.start) & (before < s.end - 1) & alnum
    edge = before[cut] + 1
    more = np.concatenate([[0], np.cumsum(cut)])
    place = np.flatnonzero(cut)
    begin, end = np.insert(s.start, place + 1, edge), np.insert(s.end, place, edge)
    keys = range_hash(s.hashed, begin, end)
    raw = s.data.tobytes() if special else b""
    for word in special:
        at = raw.find(word)
        while at >= 0:
            k = int(np.searchsorted(begin, at, side="right")) - 1
            keys[k] = int.from_bytes(hashlib.blake2b(raw[begin[k] : end[k]], digest_size=8).digest(), "little")
            at = raw.find(word, at + 1)
    return begin, end, keys, s.first + more[s.first]
