"""Words of whole texts and their 64-bit hashes, over the bytes of Arrow columns, without a Python object
for each word.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. The hash of a word is a polynomial over a
random value for each byte, modulo 2^64, with a final mix; the hash of a run of words combines the hashes
of its words by place. Hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
# All ASCII but letters and digits: what is left are terms without punctuation.
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n, _BLOCK) + 1
        _POWERS[:] = [
            np.cumprod(np.array([1] + [b] * size, np.uint64), dtype=np.uint64)
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows. A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text, so that memory doesn't follow batch size."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def split_words(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for row i the range first[i] to first[i + 1] of its words."""
    inside = ~separator[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begin[heads] = inside[heads]
    end[tails] = inside[tails]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1, np.searchsorted(start, offsets)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` treats A-Z as a-z."""
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + _BLOCK, "right")))
        hi = end[j - 1]
        power, inverse = _powers(int(hi - lo))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * power[: hi - lo], out=sums[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


def last_word(first: np.ndarray) -> np.ndarray:
    """For each word the end of its row's range."""
    return np.repeat(first[1:], np.diff(first))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words from each place on (places too near the end: of what is there)."""
    out = np.zeros(len(h), np.uint64)
    for j in range(min(k, len(h))):
        out[: len(h) - j] += h[j:] * _PLACE[j % 64] + np.uint64(j // 64)
    return mix(out)
