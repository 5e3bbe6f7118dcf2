"""BED intervals and GFF3 features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlens.functions.text import columns_of, gff_attrs, safe_int, strip
from strandlens.operators.intervals import check_bed_lines
from strandlens.sources.lines import Paths, read_numbered_lines

BED_NAMES = (".bed", ".bed.gz", ".bed.bgz")
GFF_NAMES = (".gff", ".gff3", ".gff.gz", ".gff3.gz", ".gff.bgz", ".gff3.bgz")


def read_bed_lines(spark: SparkSession, paths: Paths, check_names: bool = True) -> DataFrame:
    """Checked BED lines, for ``bed_qc`` and ``bed_issues``."""
    return check_bed_lines(read_numbered_lines(spark, paths, BED_NAMES if check_names else ()))


def read_bed(spark: SparkSession, paths: Paths, strict: bool = False, check_names: bool = True) -> DataFrame:
    """``(file, line_no, contig, start, end, name, extra)``.

    Lines without three columns and whole-number coordinates are left out, or raise an error
    with ``strict``.
    """
    lines = read_numbered_lines(spark, paths, BED_NAMES if check_names else ())
    text, parts = strip(F.col("value")), columns_of(F.col("value"))
    start, end = safe_int(F.get(parts, F.lit(1))), safe_int(F.get(parts, F.lit(2)))
    rows = lines.where((text != "") & ~text.rlike("^(#|track|browser)"))
    good = (F.size(parts) >= 3) & start.isNotNull() & end.isNotNull()
    if strict:
        # the check sits on the coordinate itself, so it cannot be pruned away
        start = F.when(good, start).otherwise(F.raise_error(F.concat(F.lit("Invalid BED entry: "), text)).cast("bigint"))
    else:
        rows = rows.where(good)
    return rows.select(
        "file",
        "line_no",
        F.get(parts, F.lit(0)).alias("contig"),
        start.alias("start"),
        end.alias("end"),
        F.get(parts, F.lit(3)).alias("name"),
        F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))).alias("extra"),
    )


def read_bed_regions(spark: SparkSession, paths: Paths, check_names: bool = True) -> DataFrame:
    """``(file, line_no, contig, start, end, name, commands)`` of a region list; any wrong line is an error.

    Columns from the fifth on hold commands cut at ``;``, without leading ``#``. Having no
    region at all is an error too, found by looking for one row.
    """
    regions = read_bed(spark, paths, True, check_names)
    commands = F.filter(
        F.flatten(
            F.transform("extra", lambda x: F.transform(F.split(F.ltrim(x, F.lit("#")), ";"), lambda c: F.trim(c)))
        ),
        lambda c: c != "",
    )
    out = regions.withColumn("commands", commands).drop("extra")
    if out.isEmpty():
        raise ValueError(f"No regions found in BED file: {paths}")
    return out


def read_gff3(spark: SparkSession, paths: Paths, check_names: bool = True) -> DataFrame:
    """``(file, line_no, seqid … phase, attrs)``; coordinates that are no whole numbers are null."""
    lines = read_numbered_lines(spark, paths, GFF_NAMES if check_names else ())
    text, p = strip(F.col("value")), columns_of(F.col("value"))
    return lines.where((text != "") & ~F.startswith(text, F.lit("##")) & (F.size(p) >= 9)).select(
        "file",
        "line_no",
        F.get(p, F.lit(0)).alias("seqid"),
        F.get(p, F.lit(1)).alias("source"),
        F.get(p, F.lit(2)).alias("type"),
        safe_int(F.get(p, F.lit(3))).alias("start"),
        safe_int(F.get(p, F.lit(4))).alias("end"),
        F.get(p, F.lit(5)).alias("score"),
        F.get(p, F.lit(6)).alias("strand"),
        F.get(p, F.lit(7)).alias("phase"),
        gff_attrs(F.get(p, F.lit(8))).alias("attrs"),
    )
