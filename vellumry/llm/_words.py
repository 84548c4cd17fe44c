"""Words of whole Arrow string columns as numpy arrays, without a Python object per word.

A word is a run of ASCII letters and digits and of bytes above 0x7F (so accented letters count); a character of
U+3000..U+DFFF (CJK, kana, Hangul) is a word by itself. Text is lower-cased first. Everything else separates words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_B = U64(0x9E3779B97F4A7C15 | 1)
_B_INV = U64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
SLICE_BYTES = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CJK = np.zeros(256, bool)
_CJK[0xE3:0xEE] = True
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^k and B^-k modulo 2^64 for k < n; kept and grown by doubling."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for at, base in ((0, _B), (1, _B_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[at] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span; equal spans have equal hashes wherever they stand."""
    up, down = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * up[:-1], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) in slices of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        last = min(last, len(texts), first + (1 << 19))
        yield first, last, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte, byte after the last) of every word."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e.astype(U64), e, e, e
    inside = _WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cjk = _CJK[data]
    if cjk.any():
        starts |= cjk
        starts[3:] |= cjk[:-3] & inside[3:]
    edge = offsets[:-1][offsets[:-1] < n]
    starts[edge] |= inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | starts[1:]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(s, offsets)))
    return span_hashes(data.astype(U64) + U64(1), s, e), row, s, e


def shingles(h: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-grams of each row's words; a row with fewer words has one shingle of all of them."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.repeat(np.arange(rows), size)
    at = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size) + first[out]
    return span_hashes(h, at, at + np.minimum(n, count[out])), out


def bags(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 44-bit hash, multiplicity) of the distinct hashes of each row, sorted by row and hash."""
    key = (row.astype(U64) << U64(44)) | (h >> U64(20))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> U64(44)).astype(np.int64), key & U64((1 << 44) - 1), np.diff(np.concatenate((at, [len(new)])))
