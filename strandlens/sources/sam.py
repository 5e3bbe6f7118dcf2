"""SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlens.functions.text import map_last_wins
from strandlens.sources.lines import Paths, read_lines

SAM_NAMES = (".sam", ".sam.gz", ".sam.bgz")


def read_sam(spark: SparkSession, paths: Paths, check_names: bool = True, blocks: bool | None = None) -> DataFrame:
    """One row per record, ``pos`` and ``pnext`` 0-based; tags as text by name, without their type.

    An absent sequence or quality (``*``) is null.
    """
    lines = read_lines(spark, paths, allowed=SAM_NAMES if check_names else (), blocks=blocks)
    f = F.split("value", "\t")
    tags = F.transform(
        F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))),
        lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(6), F.length(t)).alias("value")),
    )
    return lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("@"))).select(
        "file",
        F.get(f, F.lit(0)).alias("qname"),
        F.get(f, F.lit(1)).try_cast("int").alias("flag"),
        F.get(f, F.lit(2)).alias("contig"),
        (F.get(f, F.lit(3)).try_cast("bigint") - 1).alias("pos"),
        F.get(f, F.lit(4)).try_cast("int").alias("mapq"),
        F.get(f, F.lit(5)).alias("cigar"),
        F.get(f, F.lit(6)).alias("rnext"),
        (F.get(f, F.lit(7)).try_cast("bigint") - 1).alias("pnext"),
        F.get(f, F.lit(8)).try_cast("bigint").alias("tlen"),
        F.nullif(F.get(f, F.lit(9)), F.lit("*")).alias("seq"),
        F.nullif(F.get(f, F.lit(10)), F.lit("*")).alias("qual"),
        map_last_wins(tags).alias("tags"),
    )
