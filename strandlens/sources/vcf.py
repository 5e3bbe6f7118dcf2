"""VCF text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlens.functions.text import map_last_wins
from strandlens.sources.lines import Paths, read_lines

VCF_NAMES = (".vcf", ".vcf.gz", ".vcf.bgz")


def read_vcf(spark: SparkSession, paths: Paths, check_names: bool = True, blocks: bool | None = None) -> DataFrame:
    """One row per record; ``info`` as a map (null value for a bare flag), samples as raw calls."""
    lines = read_lines(spark, paths, allowed=VCF_NAMES if check_names else (), blocks=blocks)
    f = F.split("value", "\t")
    info = F.transform(
        F.filter(F.split(F.get(f, F.lit(7)), ";"), lambda x: (x != ".") & (x != "")),
        lambda x: F.struct(
            F.substring_index(x, "=", 1).alias("key"),
            F.when(F.contains(x, F.lit("=")), F.substring(x, F.locate("=", x) + 1, F.length(x))).alias("value"),
        ),
    )
    return lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).select(
        "file",
        F.get(f, F.lit(0)).alias("chrom"),
        F.get(f, F.lit(1)).try_cast("bigint").alias("pos"),
        F.get(f, F.lit(2)).alias("id"),
        F.get(f, F.lit(3)).alias("ref"),
        F.split(F.get(f, F.lit(4)), ",").alias("alts"),
        F.get(f, F.lit(5)).try_cast("double").alias("qual"),
        F.get(f, F.lit(6)).alias("filter"),
        map_last_wins(info).alias("info"),
        F.split(F.get(f, F.lit(8)), ":").alias("format"),
        F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("samples"),
    )
