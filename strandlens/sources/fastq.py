"""FASTQ: four-line records without a shuffle.

Text is split at a line break followed by ``@``. In a FASTQ file that is the start of a
record or of a quality line beginning with ``@``; such a record comes in two pieces, a head of
three lines and a tail of one. Whole records go straight through. Only the pieces are
grouped: neighbours in a split by their place, and those parted by the border of two
splits (at most two per split) by order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlens.session import BROADCAST_MAX_ROWS
from strandlens.sources.lines import Paths, read_kinds

FASTQ_NAMES = (".fastq", ".fq", ".fastq.gz", ".fq.gz", ".fastq.bgz", ".fq.bgz")


def _chunks(spark: SparkSession, paths: Paths, allowed: tuple[str, ...], blocks: bool | None) -> DataFrame:
    """Pieces between separators, ``begins`` for the one that is first in its file and still has its own ``@``."""
    plain, packed = read_kinds(spark, paths, "\n@", allowed, blocks)
    found = []
    if plain is not None:
        first = plain.where("block = 0").groupBy(F.col("file").alias("of_file")).agg(F.min("id").alias("first_id"))
        if len(plain.inputFiles()) <= BROADCAST_MAX_ROWS:  # one row per file
            first = F.broadcast(first)
        begins = (F.col("id") == F.col("first_id")).alias("begins")
        found.append(plain.join(first, F.col("file") == F.col("of_file"), "left").select("file", "block", "id", "value", begins))
    if packed is not None:
        found.append(packed.withColumn("begins", (F.col("block") == 0) & (F.col("id") == 0)))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def read_fastq(
    spark: SparkSession, paths: Paths, check_names: bool = True, tasks: int | None = None, blocks: bool | None = None
) -> DataFrame:
    """``(file, rec, read_id, seq, qual)``; ``rec`` rises in file order within a split.

    ``read_id`` is the header line without ``@``. Wrong records raise an error when their
    sequence or quality is used. A ``.gz`` file is one split; for a few large ones ``tasks``
    spreads the reads before any work on them. A block-gzip file (``.bgz``, or any with ``blocks``) is many splits.
    """
    chunks = _chunks(spark, paths, FASTQ_NAMES if check_names else (), blocks)
    lines = chunks.select("file", "block", F.col("id").alias("rec"), F.split("value", "\n").alias("l"), "begins")
    at = {i: F.rtrim(F.get("l", F.lit(i)), F.lit("\r")) for i in range(4)}
    has_head = F.coalesce(F.startswith(at[2], F.lit("+")), F.lit(False))
    broken = F.raise_error(F.concat(F.lit("Broken FASTQ record in "), F.col("file")))
    whole = has_head & (F.size("l") >= 4)
    # nothing but blank lines may follow a record, as at the end of a file
    rest = F.exists(F.slice("l", F.when(has_head, 5).otherwise(2), F.size("l")), lambda x: F.rtrim(x, F.lit("\r")) != "")
    leftover = F.raise_error(F.concat(F.lit("Lines after a FASTQ record in "), F.col("file")))
    header = F.when(rest, leftover.cast("string")).when(F.col("begins"), F.regexp_replace(at[0], "^@", "")).otherwise(at[0])

    complete = lines.where(whole).select("file", "rec", header.alias("read_id"), at[1].alias("seq"), at[3].alias("qual"))

    pieces = lines.where(~whole).select(
        "file",
        "block",
        (F.col("rec") - F.when(has_head, 0).otherwise(1)).alias("rec"),
        F.when(has_head, F.struct(header.alias("read_id"), at[1].alias("seq"))).alias("head"),
        # a tail is one line: more lines, none of them that of the +, are a record that just stops
        F.when(~has_head, F.when(rest, broken.cast("string")).otherwise(F.concat(F.lit("@"), at[0]))).alias("tail"),
    )
    met = pieces.groupBy("file", "block", "rec").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    both = F.col("head").isNotNull() & F.col("tail").isNotNull()
    order = Window.partitionBy("file").orderBy("block", "rec")
    parted = met.where(~both).select(
        "file", "rec", "head", "tail", F.lead("tail").over(order).alias("next"), F.lag("head").over(order).alias("previous")
    )
    is_head = F.col("head").isNotNull()
    lost = (is_head & F.col("next").isNull()) | (~is_head & F.col("previous").isNull())
    rejoined = parted.where(F.when(lost, broken.cast("boolean")).otherwise(is_head)).select(
        "file", "rec", "head", F.col("next").alias("tail")
    )
    mended = met.where(both).select("file", "rec", "head", "tail").unionByName(rejoined)
    reads = complete.unionByName(mended.select("file", "rec", "head.read_id", "head.seq", F.col("tail").alias("qual")))
    return _checked(reads if tasks is None else reads.repartition(tasks, "file", "rec"))


def _checked(reads: DataFrame) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("Sequence and quality differ in length: "), F.col("read_id"), F.lit(" in "), F.col("file")))

    def fitting(c: str) -> Column:
        return F.when(F.length("seq") == F.length("qual"), F.col(c)).otherwise(bad.cast("string"))

    return reads.select("file", "rec", "read_id", "seq", fitting("qual").alias("qual"))
