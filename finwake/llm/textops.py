"""Whole-batch text work on Arrow string buffers with numpy.

A batch of texts is one flat byte array with row offsets. It is taken in slices of
whole rows of about ``SLICE`` bytes, so memory follows the slice (or one long row).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 20
_CACHE: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**j and B**-j modulo 2**64 for an odd base drawn from the seed; grown and kept per process."""
    base = (int(mix(np.array([seed + 77], np.uint64))[0]) | 5) & ~2  # 1 or 5 modulo 8: a long period
    key = (seed, 0)
    if key not in _CACHE or len(_CACHE[key][0]) < n:
        size = max(n, SLICE + 1024)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _CACHE[key] = tuple(out)
    p, q = _CACHE[key]
    return p[:n], q[:n]


def prefix_sums(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """S with S[e] - S[s] = hash of data[s:e] times B**s."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    p, _ = powers(seed, max(1, len(data)))
    np.cumsum(byte_values(seed)[data] * p[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """Content hashes of the spans [start, end); equal contents hash equal wherever they stand."""
    _, q = powers(seed, max(1, len(sums)))
    return mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))


LONG = 64  # bytes; below, no known pattern makes sums modulo 2**64 meet


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """Content hashes of words: as ``span_hashes``, and by XXH64 where a word is long enough to break those."""
    out = span_hashes(prefix_sums(data, seed), start, end, seed)
    for i in np.flatnonzero(end - start > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows within bytes) for runs of whole rows; null is empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        if pa.types.is_string_view(chunk.type) or not (
            pa.types.is_string(chunk.type)
            or pa.types.is_large_string(chunk.type)
            or pa.types.is_binary(chunk.type)
            or pa.types.is_large_binary(chunk.type)
        ):
            chunk = chunk.cast(pa.large_string())
        n = len(chunk)
        if n == 0:
            continue
        if chunk.null_count:
            empty = b"" if pa.types.is_binary(chunk.type) or pa.types.is_large_binary(chunk.type) else ""
            chunk = chunk.fill_null(empty)
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        _, off, buf = chunk.buffers()
        offsets = np.frombuffer(off, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
        data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
            b = min(n, max(a + 1, b))
            yield base + a, base + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b
        base += n


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, true for the byte ranges (both ends included)."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


# Byte classes: white space as [\x20\x09-\x0D]; everything but ASCII letters, digits and non-ASCII.
SPACE = table_of((0x20, 0x20), (0x09, 0x0D))
NOT_WORD = ~table_of((48, 57), (65, 90), (97, 122), (128, 255))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of non-separators; runs end at row ends."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


# Blocks of scripts that are written without spaces.
SPACELESS = (
    (0x0E00, 0x109F),  # Thai, Lao, Tibetan, Myanmar
    (0x1780, 0x17FF),  # Khmer
    (0x1950, 0x19FF),
    (0x1A20, 0x1AAF),
    (0x2E80, 0x2FDF),
    (0x3005, 0x312F),  # kana
    (0x31A0, 0x31BF),
    (0x31F0, 0x31FF),
    (0x3400, 0x4DBF),
    (0x4E00, 0xA4CF),  # Chinese characters, Yi
    (0xA980, 0xA9DF),
    (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F),
    (0x16FE0, 0x18DFF),
    (0x1AFF0, 0x1B2FF),
    (0x20000, 0x3FFFF),
)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: 0 a separator, 1 part of a word, 2 a word of its own."""
    out = np.ones(0x40001, np.uint8)  # the last stands for all that follow
    out[:128] = ~NOT_WORD[:128]
    alone = np.zeros(len(out), bool)
    for a, b in SPACELESS:
        alone[a : b + 1] = True
    for c in range(128, 0x20000):
        kind = unicodedata.category(chr(c))
        if kind in ("So", "Sm", "Sc"):
            out[c] = 2
        elif kind[0] in "ZPS" or kind in ("Cc", "Cf"):
            out[c] = 0
        elif alone[c]:
            out[c] = 2
    out[0x20000:0x40000] = 2
    return out


def unicode_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of letters, marks and digits of any script; a character of a script without spaces, or a symbol, is a word."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return words(data, offsets, NOT_WORD)
    n = len(data)
    byte = lambda j: data[np.minimum(lead + j, n - 1)].astype(np.int64)
    b, b1, b2, b3 = (byte(j) for j in range(4))
    size = 2 + (b >= 0xE0) + (b >= 0xF0)
    two, three = (b & 31) << 6 | b1 & 63, (b & 15) << 12 | (b1 & 63) << 6 | b2 & 63
    four = (b & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63
    code = np.where(size == 2, two, np.where(size == 3, three, four))
    kind = _kinds()[np.minimum(code, 0x40000)]
    inside = ~NOT_WORD[data]
    for j in range(4):
        here = (size > j) & (lead + j < n)
        inside[lead[here] + j] = kind[here] > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    a = lead[kind == 2]
    z = np.minimum(a + size[kind == 2], n)
    cuts = np.concatenate([offsets[1:-1], a, z])
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1
