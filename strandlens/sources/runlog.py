"""Sequencer run logs: tab-separated text with a header line whose columns vary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlens.functions.text import columns_of, safe_float, safe_int, strip
from strandlens.session import BROADCAST_MAX_ROWS
from strandlens.sources.lines import Paths, read_heads, read_numbered_lines

# Column names by field, exact ones first, then parts of a name.
RUN_COLUMNS = {
    "length": (("sequence_length_template",), ("sequence_length", "length")),
    "qscore": (("mean_qscore_template",), ("qscore", "quality")),
    "start_time": (("start_time",), ("start_time",)),
    "channel": (("channel",), ("channel",)),
}
RUN_NAMES = (".txt", ".tsv", ".txt.gz", ".tsv.gz")


def resolve_column(columns: Column, exact: Sequence[str], parts: Sequence[str]) -> Column:
    """0-based place of a column in an array of names, null if there is none.

    A full name in lower case wins; else the first column in header order that contains a part.
    Of equal names the last one counts.
    """
    names = F.transform(columns, lambda c: F.lower(c))
    size = F.size(names)
    found = [F.when(F.array_contains(names, n), size - F.array_position(F.reverse(names), n)) for n in exact]
    contains = F.transform(names, lambda c: F.when(c.rlike("|".join(parts)), F.lit(True)).otherwise(F.lit(False)))
    first_part = F.when(F.array_contains(contains, True), F.array_position(contains, True) - 1)
    first_name = F.get(names, first_part.cast("int"))
    return F.coalesce(*found, size - F.array_position(F.reverse(names), first_name)).cast("int")


def run_headers(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(file, length, qscore, start_time, channel)`` places; one row per file with a header."""
    heads = read_heads(spark, paths, max_lines=1).where(strip(F.col("value")) != "")
    columns = columns_of(F.col("value"))
    places = {name: resolve_column(columns, *names) for name, names in RUN_COLUMNS.items()}
    missing = F.raise_error(F.concat(F.lit("No column of read lengths (sequence_length_template) in "), F.col("file")))
    places["length"] = F.coalesce(places["length"], missing.cast("int"))
    return heads.select("file", *[c.alias(name) for name, c in places.items()])


def read_sequencing_summary(spark: SparkSession, paths: Paths, check_names: bool = True) -> DataFrame:
    """``(file, row, length, start_time, qscore, channel)``.

    Columns are bound per file, so logs of different layout load together. A row without a
    whole-number length is dropped; other values that do not parse are null.
    """
    lines = read_numbered_lines(spark, paths, RUN_NAMES if check_names else ())
    headers = run_headers(spark, paths).select("file", *[F.col(n).alias(f"at_{n}") for n in RUN_COLUMNS])
    if len(lines.inputFiles()) <= BROADCAST_MAX_ROWS:  # one row per file
        headers = F.broadcast(headers)
    cells = lines.where(F.col("line_no") > 1).withColumn("p", columns_of(F.col("value"))).join(headers, "file")

    def cell(name: str) -> Column:
        return F.get("p", F.col(f"at_{name}"))

    return cells.select(
        "file",
        F.col("line_no").alias("row"),
        safe_int(cell("length")).alias("length"),
        safe_float(cell("start_time")).alias("start_time"),
        safe_float(cell("qscore")).alias("qscore"),
        safe_int(cell("channel")).alias("channel"),
    ).where(F.col("length").isNotNull())
