"""Joins on input labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that takes null labels as equal, and keeps the left side's keys.

    An ordinary join on nullable keys drops nulls, and adds not-null filters that make two
    uses of one aggregate look different, so that Spark would compute it twice.
    """
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, same), how).drop(*[f"_r_{k}" for k in keys])


def with_inputs(stats: DataFrame, by: Sequence[str], files: DataFrame | None, counts: Sequence[str]) -> DataFrame:
    """``stats`` with a row for every input in ``files``: zero ``counts`` and nulls for one without records."""
    if files is None:
        return stats
    return join_on(files.select(*by).distinct(), stats, by, "left").fillna(0, list(counts))
