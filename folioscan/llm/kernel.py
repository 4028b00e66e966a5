"""Words and hashes of many texts at once, on byte arrays. Used inside tasks only; Spark deals out the rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on together; a longer text is a chunk of its own. Each byte takes some 40 bytes of arrays.
CHUNK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(spans: list[tuple[int, int]], inside: bool = True) -> np.ndarray:
    """A table over bytes: inside the spans, or outside them."""
    table = np.full(256, not inside)
    for lo, hi in spans:
        table[lo : hi + 1] = inside
    return table


# Words of any bytes that are not ASCII white space.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)], inside=False)
# Words of digits, lower-case letters and bytes over 0x7F.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], inside=False)


def column(array) -> pa.Array:
    """A text or binary column as one large binary array without nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.large_binary()).fill_null(b"")


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and the offset of each value with the end behind the last."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts."""
    values = column(array)
    if not len(values):
        return
    data, at = raw(values)
    row = 0
    while row < len(values):
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first word (one more entry at the end)."""
    m = kind[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    full = at[:-1] < at[1:]
    a, b = at[:-1][full], at[1:][full] - 1
    first[a], last[b] = m[a], m[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _letters(seed: int) -> tuple[np.ndarray, int, int]:
    """A random number for each byte, an odd base and its inverse modulo 2**64."""
    draw = np.random.default_rng(seed)
    base = int(draw.integers(1 << 62)) * 4 + 5
    return draw.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), base, pow(base, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; only tables of chunk size are kept."""
    have = _POWERS.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    out = np.full(max(n, CHUNK + 2), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= CHUNK + 2:
        _POWERS[base] = out
    return out[:n]


class Prefix:
    """Prefix sums of a text, from which the hash of any piece of it follows in constant time."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        table, base, self.inverse = _letters(seed)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers(base, len(data)), out=self.sums[1:])

    def pieces(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), alike for alike bytes wherever they stand."""
        back = powers(self.inverse, len(self.sums))
        own = (self.sums[ends] - self.sums[starts]) * back[starts]
        return mix(own + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word."""
    return Prefix(data, seed).pieces(starts, ends)


def ngram_hashes(hashes: np.ndarray, n: int, seed: int = 2) -> np.ndarray:
    """A 64-bit hash for each n words in a row; the caller leaves out those that cross texts."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    odd = np.random.default_rng(seed).integers(1 << 62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = hashes[:m] * odd[0]
    for k in range(1, n):
        total += hashes[k : k + m] * odd[k]
    return mix(total)


def inside(first_word: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each word position with n - 1 more words in the array: do they belong to one text?"""
    m = max(0, total - n + 1)
    ok = np.ones(m, bool)
    for k in range(1, n):
        cross = first_word[1:-1] - k
        ok[cross[(cross >= 0) & (cross < m)]] = False
    return ok


def per_text(flags: np.ndarray, first_word: np.ndarray) -> np.ndarray:
    """Sum of a value per word over each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first_word[1:]] - sums[first_word[:-1]]
