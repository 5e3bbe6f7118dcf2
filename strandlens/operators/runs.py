"""Sequencer run logs: yield, N50, channels, duration, yield per hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlens.operators.distribution import order_statistics, tally
from strandlens.operators.joins import join_on, with_inputs

SECONDS_PER_HOUR = 3600.0


def run_stats(runs: DataFrame, by: Sequence[str] = ("file",), files: DataFrame | None = None) -> DataFrame:
    """One row per run log; ``files`` adds zero rows for logs without a single read.

    Start times are seconds and durations hours. Quality is averaged over parseable values,
    channels are counted without repeats, both null when there are none. One scan of the log.
    """
    measures = {name: F.col(name) for name in ("length", "qscore", "start_time", "channel")}
    stats = order_statistics(tally(runs, measures, by), by)

    def of(metric: str, value: Column) -> Column:
        return F.max(F.when(F.col("metric") == metric, value))

    out = stats.groupBy(*by).agg(
        of("length", F.col("total").cast("bigint")).alias("total_yield"),
        of("length", F.col("n")).alias("total_reads"),
        of("length", F.col("nx").cast("bigint")).alias("n50"),
        of("length", F.col("mean")).alias("mean_length"),
        of("qscore", F.col("mean")).alias("mean_qscore"),
        of("channel", F.col("distinct")).alias("active_channels"),
        of("start_time", (F.col("high") - F.col("low")) / SECONDS_PER_HOUR).alias("run_duration_hours"),
    )
    return with_inputs(out, by, files, ["total_reads", "total_yield"])


def active_channels(runs: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Distinct channels per input; counted in two steps so that no task holds one input's set."""
    return (
        runs.where(F.col("channel").isNotNull())
        .groupBy(*by, "channel")
        .agg(F.lit(1).alias("seen"))
        .groupBy(*by)
        .agg(F.count("*").alias("active_channels"))
    )


def yield_per_hour(runs: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, window_start_hours, yield_bp, read_count)``.

    One-hour half-open windows from the first read's start; empty windows are left out, reads
    without a start time too, and an input whose times are all equal has no windows.
    """
    timed = (
        runs.where(F.col("start_time").isNotNull())
        .groupBy(*by, (F.col("start_time") / SECONDS_PER_HOUR).alias("h"))
        .agg(F.sum("length").alias("bp"), F.count("*").alias("reads"))
    )
    # all columns of the sums are read here too, so that both uses share one scan and shuffle
    span = timed.groupBy(*by).agg(
        F.min("h").alias("first"), F.max("h").alias("last"), F.sum("reads").alias("all_reads"), F.count("bp").alias("starts")
    )
    span = span.where((F.col("last") > F.col("first")) & (F.col("all_reads") > 1) & (F.col("starts") > 1))
    step = F.floor(F.col("h") - F.col("first"))
    # keep to the window borders first + k where the subtraction was rounded across one
    window = (
        F.when(F.col("h") < F.col("first") + step, step - 1)
        .when(F.col("h") >= F.col("first") + step + 1, step + 1)
        .otherwise(step)
    )
    return (
        join_on(timed, span, by)
        .groupBy(*by, (F.col("first") + window).alias("window_start_hours"))
        .agg(F.sum("bp").cast("bigint").alias("yield_bp"), F.sum("reads").alias("read_count"))
    )
