"""Vectors for searches: which take part, and their packing for tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def matrix(lists: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled with zeros, which add nothing to a product."""
    at = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    if len(sizes) and (sizes == width).all():
        return flat[at[0] : at[-1]].reshape(-1, width).astype(dtype)
    out = np.zeros((len(sizes), width), dtype)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def packed(rows: np.ndarray) -> list[bytes]:
    rows = np.ascontiguousarray(rows)
    return [r.tobytes() for r in rows]
