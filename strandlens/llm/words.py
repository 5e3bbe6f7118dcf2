"""Words of many texts at once: places and hashes by numpy, for operators on word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
MAX_BYTES = 1 << 20
SLICE_BYTES = 1 << 18
"""Text that is looked at as one: arrays of eight bytes for each of its bytes stay with the Python process, stage after stage."""


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _letters() -> np.ndarray:
    """A random number for each byte, that of the small letter for A to Z."""
    numbers = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
    numbers[0x41:0x5B] = numbers[0x61:0x7B]
    return numbers


_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the largest ``size`` so far up to a bound."""
    if _powers and len(_powers[0]) >= size:
        return _powers[0][:size], _powers[1][:size]
    tables = []
    for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        tables.append(np.cumprod(powers, dtype=np.uint64))
    if size <= 4 * MAX_BYTES:
        _powers[:] = tables
    return tables[0], tables[1]


@lru_cache(4)
def separators(kind: str) -> np.ndarray:
    """``space``: bytes of white space part words; ``punctuation``: all but letters, digits and non-ASCII do."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = True
    else:
        table[:0x80] = True
        for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            table[low:high] = False
    return table


@dataclass
class Words:
    """Hashes of all words in order (A-Z as a-z), and where each text's words begin (one more entry)."""

    hashes: np.ndarray
    begins: np.ndarray

    @property
    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.begins) - 1), np.diff(self.begins))


def hashed_words(texts: pa.Array, kind: str = "space") -> Words:
    """Words of an array of strings; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
    gap = separators(kind)[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    border = at[at < n]
    begins[border] = ~gap[border]
    ends = ~gap
    ends[:-1] &= gap[1:]
    last = at[(at > 0)] - 1
    ends[last] = ~gap[last]
    first, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_letters()[data] * powers, out=sums[1:])
    hashes = mixed((sums[stop] - sums[first]) * inverse[first] + (stop - first).astype(np.uint64))
    return Words(hashes, np.searchsorted(first, at))


def chained(hashes: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``i + s`` for all steps ``s``, for each ``i`` where the last is inside."""
    n = max(0, len(hashes) - steps[-1])
    out = np.zeros(n, np.uint64)
    for s in steps:
        out = out * _FOLD + hashes[s : s + n]
    return mixed(out + np.uint64(len(steps) * 64 + steps[-1]))


def slices(batch: pa.RecordBatch, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``max_bytes``, one row at least."""
    rows = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
