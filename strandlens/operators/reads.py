"""Statistics and filters on reads."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlens.functions import reads as fn
from strandlens.functions.arrowtext import byte_view
from strandlens.operators.distribution import (
    LENGTH_BIN,
    PERCENTILES,
    QSCORE_BIN,
    histograms_of_tally,
    order_statistics,
    tally,
)
from strandlens.operators.joins import with_inputs

# Trimming strategies.
TRIM_APPROACHES = ("fixed-crop", "trim-by-quality")


def read_metrics(reads: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, length, gc, qscore)`` per read; the narrow table all read statistics start from."""
    return reads.select(
        *by,
        fn.read_length(F.col("seq")).alias("length"),
        fn.gc_count(F.col("seq")).alias("gc"),
        fn.mean_qscore(F.col("qual")).alias("qscore"),
    )


def read_tally(metrics: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    return tally(metrics, {name: F.col(name) for name in ("length", "qscore", "gc")}, by)


def read_stats_of_tally(counts: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    probs = tuple(PERCENTILES.values())
    median = probs.index(0.50)
    stats = order_statistics(counts, by, probs)
    is_len, is_q = F.col("metric") == "length", F.col("metric") == "qscore"

    def pick(condition: Column, value: Column) -> Column:
        return F.max(F.when(condition, value))

    return stats.groupBy(*by).agg(
        pick(is_len, F.col("n")).alias("read_count"),
        pick(is_len, F.col("total").cast("bigint")).alias("total_bases"),
        pick(is_len, F.col("low").cast("bigint")).alias("min_len"),
        pick(is_len, F.col("high").cast("bigint")).alias("max_len"),
        pick(is_len, F.col("mean")).alias("mean_len"),
        pick(is_len, F.col("quantiles")[median]).alias("median_len"),
        pick(is_len, F.col("nx").cast("bigint")).alias("n50"),
        pick(is_q, F.col("mean")).alias("mean_qscore"),
        pick(is_q, F.col("quantiles")[median]).alias("median_qscore"),
        (pick(F.col("metric") == "gc", F.col("total")) / F.nullif(pick(is_len, F.col("total")), F.lit(0.0))).alias(
            "gc_content"
        ),
        *[pick(is_len, F.col("quantiles")[i]).alias(name) for i, name in enumerate(PERCENTILES)],
    )


def read_stats(reads: DataFrame, by: Sequence[str] = ("file",), files: DataFrame | None = None) -> DataFrame:
    """Counts, lengths, N50, qualities, GC proportion and length percentiles per input.

    One scan of the reads and one shuffle of their distinct lengths and qualities. ``files`` adds zero
    rows for inputs without a read.
    """
    stats = read_stats_of_tally(read_tally(read_metrics(reads, by), by), by)
    return with_inputs(stats, by, files, ["read_count", "total_bases"])


def read_length_histogram(reads: DataFrame, bin_width: float = LENGTH_BIN, by: Sequence[str] = ("file",)) -> DataFrame:
    counts = tally(reads, {"length": fn.read_length(F.col("seq"))}, by)
    return histograms_of_tally(counts, {"length": bin_width}, by).drop("metric")


def read_qscore_histogram(reads: DataFrame, bin_width: float = QSCORE_BIN, by: Sequence[str] = ("file",)) -> DataFrame:
    return histograms_of_tally(qscore_tally(reads, by), {"qscore": bin_width}, by).drop("metric")


def qscore_tally(reads: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    scored = reads.select(*by, fn.mean_qscore(F.col("qual")).alias("qscore"))
    return tally(scored, {"qscore": F.col("qscore")}, by)


def qscore_stats(reads: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, mean_qscore, median_qscore)``."""
    stats = order_statistics(qscore_tally(reads, by), by)
    return stats.select(*by, F.col("mean").alias("mean_qscore"), F.col("quantiles")[0].alias("median_qscore"))


def per_position_quality(reads: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, cycle, reads, mean_q)``: mean Phred value at each 1-based position.

    Sums are taken per Arrow batch in numpy, so a shuffle row stands for a position of a
    batch and not for a base.
    """
    by = list(by)
    narrow = reads.select(*by, "qual")
    schema = narrow.select(*by, F.lit(0).cast("bigint").alias("cycle"), F.lit(0).cast("bigint").alias("reads"),
                           F.lit(0).cast("bigint").alias("q")).schema

    def sum_batch(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = np.zeros(len(table), np.int64)
            if by:
                seen: dict[tuple, int] = {}
                rows = zip(*(table[b].to_pylist() for b in by))
                codes = np.array([seen.setdefault(r, len(seen)) for r in rows], np.int64)
            groups = np.unique(codes)
            for group in groups:
                part = table if len(groups) == 1 else table.filter(pa.array(codes == group))
                data, starts, ends = byte_view(part["qual"].combine_chunks())
                if len(data) == 0:
                    continue
                cycle = np.arange(len(data)) - np.repeat(starts, ends - starts)
                count = np.bincount(cycle)
                total = np.bincount(cycle, weights=data.astype(np.int64) - fn.PHRED_OFFSET)
                head = part.slice(0, 1)
                size = len(count)
                columns = [pa.array(head[b].to_pylist() * size, table.schema.field(b).type) for b in by]
                columns += [
                    pa.array(np.arange(1, size + 1)),
                    pa.array(count.astype(np.int64)),
                    pa.array(total.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*by, "cycle", "reads", "q"])

    return (
        narrow.mapInArrow(sum_batch, schema)
        .groupBy(*by, "cycle")
        .agg(F.sum("reads").alias("reads"), F.sum("q").alias("q"))
        .select(*by, "cycle", "reads", (F.col("q") / F.col("reads")).alias("mean_q"))
    )


def filter_reads(
    reads: DataFrame,
    min_len: int | None = None,
    max_len: int | None = None,
    min_qual: float | None = None,
    max_qual: float | None = None,
) -> DataFrame:
    """Reads within limits of length and of mean quality, both ends included."""
    keep = _between(F.length("seq"), min_len, max_len)
    if min_qual is None and max_qual is None:
        return reads.where(keep)
    keep = keep & _between(fn.mean_qscore(F.col("qual"), pinned=True), min_qual, max_qual)
    return reads.withColumn("_keep", keep).where("_keep").drop("_keep")


def filter_reads_length(reads: DataFrame, min_len: int | None = None, max_len: int | None = None) -> DataFrame:
    return filter_reads(reads, min_len, max_len)


def filter_reads_quality(reads: DataFrame, min_qual: float | None = None, max_qual: float | None = None) -> DataFrame:
    return filter_reads(reads, min_qual=min_qual, max_qual=max_qual)


def _between(value: Column, low: float | None, high: float | None) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.coalesce(ok, F.lit(False))


def trim_reads(
    reads: DataFrame,
    *,
    headcrop: int = 0,
    tailcrop: int = 0,
    minlength: int = 1,
    maxlength: int | None = None,
    quality: float = 0,
    cutoff: int | None = None,
    trim_approach: str | None = None,
) -> DataFrame:
    """Adds ``trimmed_seq``, ``trimmed_qual`` and ``passed``.

    In this order: the quality of the raw read is checked, the read is trimmed, the length
    of what is left is checked.
    """
    for name, value in {"headcrop": headcrop, "tailcrop": tailcrop, "minlength": minlength}.items():
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise ValueError(f"{name} must be a whole number >= 0, got {value!r}")
    if maxlength is not None and (isinstance(maxlength, bool) or not isinstance(maxlength, int)):
        raise ValueError(f"maxlength must be a whole number, got {maxlength!r}")
    if isinstance(quality, bool) or not isinstance(quality, (int, float)):
        raise ValueError(f"quality must be a number, got {quality!r}")
    approach = trim_approach or "fixed-crop"
    if approach not in TRIM_APPROACHES:
        raise ValueError(f"trim_approach must be one of {TRIM_APPROACHES}, got {trim_approach!r}")
    if approach == "trim-by-quality":
        if isinstance(cutoff, bool) or not isinstance(cutoff, int) or not 0 <= cutoff <= 93:
            raise ValueError(f"trim-by-quality needs a cutoff of 0 to 93, got {cutoff!r}")
        start, size = fn.quality_span(F.col("qual"), cutoff)
        cut = {c: F.substring(F.col(c), start, size) for c in ("seq", "qual")}
        left = F.greatest(F.least(size, F.length("seq") - start + 1), F.lit(0))
    else:
        cut = {c: fn.crop(F.col(c), headcrop, tailcrop) for c in ("seq", "qual")}
        left = F.greatest(F.length("seq") - (headcrop + tailcrop), F.lit(0))
    # the length of what is left, not of a substring: the optimizer would copy the cutting into the filter
    long_enough = _between(left, minlength, maxlength)
    good = _between(fn.mean_qscore(F.col("qual"), pinned=True), quality, None) if quality > 0 else F.lit(True)
    return reads.withColumns({**{f"trimmed_{c}": e for c, e in cut.items()}, "passed": long_enough & good})


def filter_trim(reads: DataFrame, *, inverse: bool = False, **options) -> DataFrame:
    """Reads that pass, trimmed; with ``inverse`` those that do not, as they came in."""
    marked = trim_reads(reads, **options)
    if inverse:
        return marked.where(~F.col("passed")).drop("trimmed_seq", "trimmed_qual", "passed")
    return (
        marked.where(F.col("passed"))
        .withColumns({"seq": F.col("trimmed_seq"), "qual": F.col("trimmed_qual")})
        .drop("trimmed_seq", "trimmed_qual", "passed")
    )


def filter_report(
    reads: DataFrame, by: Sequence[str] = ("file",), *, inverse: bool = False, files: DataFrame | None = None, **options
) -> DataFrame:
    """``(*by, input_reads, output_reads, filtered_reads)`` in one pass; ``files`` adds inputs without a read."""
    kept = F.col("passed") != F.lit(inverse)
    out = (
        trim_reads(reads, **options)
        .groupBy(*by)
        .agg(F.count("*").alias("input_reads"), F.count_if(kept).alias("output_reads"))
        .withColumn("filtered_reads", F.col("input_reads") - F.col("output_reads"))
    )
    return with_inputs(out, by, files, ["input_reads", "output_reads", "filtered_reads"])
