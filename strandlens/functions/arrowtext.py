"""Byte-level view of an Arrow text column, shared by the Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of all texts of a batch; a null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(bounds) == 0:
        bounds = np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, bounds[:-1] - bounds[0], bounds[1:] - bounds[0]


def numbers_before(data: np.ndarray, ends: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Value of the ``digits`` decimal digits that stop right before each position in ``ends``."""
    value = np.zeros(len(ends), np.int64)
    for place in range(int(digits.max(initial=0))):
        here = digits > place
        value[here] += (data[ends[here] - 1 - place].astype(np.int64) - 48) * 10**place
    return value
