"""Helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlens.session import scratch_dir

SPACE = r"\x20\x09-\x0D"
"""Characters that part words, as a regular expression class."""

BROADCAST_MAX_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{label}")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside: a batch is held whole by the executor and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    # none or less than one means no limit
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


# Rows of whole texts that the reader and Python hold at once; a text longer than that is a batch of its own.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of the session, for tables that run after the function that makes them has returned.

    Unlike ``batches_of`` this stays. Smaller settings are kept; no result changes.
    """
    for name, most in SMALL_BATCHES.items():
        known = re.fullmatch(r"(\d+)([kmg]?)i?b?", spark.conf.get(name).strip().lower())
        if not known or int(known[1]) * _UNITS[known[2]] > most:
            spark.conf.set(name, most)


HOT_KEYS = 4096


def join_skewed(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` with ``table``: one row a key, ``count`` says how many of ``rows`` have it.

    Keys with more than one of 4096 parts of all rows, of which there are fewer than 4096 at any size, are broadcast;
    the rows of all others are shuffled. Reads ``rows`` twice, so give a table that was written. Null keys
    match nothing. ``how`` is ``inner`` or ``left``; ``count`` is not in the result.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) * HOT_KEYS > total).drop(count)
    few = table.where(F.col(count) * HOT_KEYS <= total).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(few, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted bytes stay below ``max_bytes``, else without.

    Counts all rows and the bytes of all string and binary columns; other columns count 8 bytes. Without the
    hint the join is a shuffled one, whose skewed partitions adaptive execution splits.
    """
    width = F.lit(0)
    for name, kind in df.dtypes:
        width = width + (F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space, tab and line breaks; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")
