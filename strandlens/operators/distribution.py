"""Exact distributions without collecting a group in one task.

Quantiles, N50 and histograms all work on a *tally*: one row per input, metric and distinct
value with its count. The tally is the only step that sees every read; Spark combines it
before the shuffle and spreads one input's rows over all tasks, however many reads it has.

Order statistics then need running totals along the sorted values. These are taken in two
levels: totals of coarse value buckets (few rows per input), and the rows of just those
buckets in which a wanted rank falls. So no window ever sorts a whole input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlens.operators.joins import join_on

# The reported percentiles.
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99}

LENGTH_BIN = 2000
QSCORE_BIN = 1.0

# width of the coarse buckets per metric; any other metric has buckets of width 1
_WIDTH = {"length": 1000.0, "gc": 1000.0, "qscore": 0.001, "identity": 0.01, "depth": 16.0, "start_time": 3600.0}


def tally(df: DataFrame, measures: Mapping[str, Column], by: Sequence[str] = ("file",)) -> DataFrame:
    """Counts per distinct value: ``(*by, metric, value, n)``.

    All measures come out of one pass over ``df``. Null, NaN and infinite values are not
    counted. Users of one tally must read all of its columns and not filter it, so that
    Spark finds their shuffles equal and runs the scan once.
    """
    cells = [F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value")) for name, c in measures.items()]
    return (
        df.select(*by, F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
        .groupBy(*by, "metric", "value")
        .agg(F.count("*").alias("n"))
    )


def order_statistics(
    counts: DataFrame,
    by: Sequence[str] = ("file",),
    probs: Sequence[float] = (0.5,),
    nx: float = 0.5,
    widths: Mapping[str, float] | None = None,
) -> DataFrame:
    """``(*by, metric, n, distinct, total, low, high, mean, quantiles, nx)`` of a tally.

    ``quantiles`` holds one value per entry of ``probs``, interpolated linearly at rank
    ``q * (n - 1)``. ``nx`` is the largest value at which the sum of all values at or above
    it reaches ``nx`` of the total. Both are exact.
    """
    keys = [*by, "metric"]
    widths = {**_WIDTH, **(widths or {})}
    width = F.lit(1.0)
    for name, w in widths.items():
        width = F.when(F.col("metric") == name, F.lit(float(w))).otherwise(width)
    rows = counts.withColumn("bucket", F.floor(F.col("value") / width)).withColumn("w", F.col("value") * F.col("n"))

    whole = Window.partitionBy(*keys)
    up = whole.orderBy("bucket")
    down = whole.orderBy(F.desc("bucket"))
    earlier = (Window.unboundedPreceding, -1)
    buckets = (
        rows.groupBy(*keys, "bucket")
        .agg(
            F.sum("n").alias("b_n"),
            F.count("*").alias("b_distinct"),
            F.sum("w").alias("b_w"),
            F.min("value").alias("b_low"),
            F.max("value").alias("b_high"),
        )
        .select(
            *keys,
            "bucket",
            "b_n",
            "b_w",
            F.sum("b_n").over(whole).alias("all_n"),
            F.sum("b_distinct").over(whole).alias("all_distinct"),
            F.sum("b_w").over(whole).alias("all_w"),
            F.min("b_low").over(whole).alias("low"),
            F.max("b_high").over(whole).alias("high"),
            F.coalesce(F.sum("b_n").over(up.rowsBetween(*earlier)), F.lit(0)).alias("below_n"),
            F.coalesce(F.sum("b_w").over(down.rowsBetween(*earlier)), F.lit(0.0)).alias("above_w"),
        )
    )
    ranks = F.array_distinct(
        F.flatten(
            F.array(
                *[
                    F.array(lo, F.least(lo + 1, F.col("all_n") - 1))
                    for lo in (F.floor(F.lit(float(p)) * (F.col("all_n") - 1)) for p in probs)
                ]
            )
        )
    )
    half = F.col("all_w") * nx

    def reached(above: Column, here: Column, is_top: Column) -> Column:
        return (above + here >= half) & ((above < half) | is_top)

    wanted = (
        buckets.withColumn("ranks", ranks)
        .withColumn(
            "ranks", F.filter("ranks", lambda r: (r >= F.col("below_n")) & (r < F.col("below_n") + F.col("b_n")))
        )
        .withColumn("has_nx", reached(F.col("above_w"), F.col("b_w"), F.col("below_n") + F.col("b_n") == F.col("all_n")))
        .where((F.size("ranks") > 0) | F.col("has_nx"))
    )
    inner = Window.partitionBy(*keys, "bucket")
    fine = (
        join_on(rows, wanted, [*keys, "bucket"])
        .withColumn(
            "first_rank",
            F.col("below_n")
            + F.coalesce(F.sum("n").over(inner.orderBy("value").rowsBetween(*earlier)), F.lit(0)),
        )
        .withColumn(
            "above",
            F.col("above_w")
            + F.coalesce(F.sum("w").over(inner.orderBy(F.desc("value")).rowsBetween(*earlier)), F.lit(0.0)),
        )
        .withColumn(
            "hits",
            F.transform(
                F.filter("ranks", lambda r: (r >= F.col("first_rank")) & (r < F.col("first_rank") + F.col("n"))),
                lambda r: F.struct(r.alias("rank"), F.col("value").alias("value")),
            ),
        )
        .withColumn(
            "nx_value",
            F.when(
                F.col("has_nx") & reached(F.col("above"), F.col("w"), F.col("first_rank") + F.col("n") == F.col("all_n")),
                F.col("value"),
            ),
        )
        .where((F.size("hits") > 0) | F.col("nx_value").isNotNull())
    )
    found = fine.groupBy(*keys).agg(
        F.max("all_n").alias("n"),
        F.max("all_distinct").alias("distinct"),
        F.max("all_w").alias("total"),
        F.max("low").alias("low"),
        F.max("high").alias("high"),
        F.map_from_entries(F.flatten(F.collect_list("hits"))).alias("at_rank"),
        F.max("nx_value").alias("nx"),
    )

    def quantile(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        lo = F.floor(place)
        frac = place - lo
        return F.col("at_rank")[lo] * (1 - frac) + F.col("at_rank")[F.least(lo + 1, F.col("n") - 1)] * frac

    return found.select(
        *keys,
        "n",
        "distinct",
        "total",
        "low",
        "high",
        (F.col("total") / F.col("n")).alias("mean"),
        F.array(*[quantile(p) for p in probs]).alias("quantiles"),
        "nx",
    )


def n50(df: DataFrame, length: str = "length", by: Sequence[str] = ("file",), fraction: float = 0.5) -> DataFrame:
    """``(*by, n50)``; ``fraction`` other than one half gives N90 and the like."""
    stats = order_statistics(tally(df, {"length": F.col(length)}, by), by, (0.5,), fraction)
    return stats.select(*by, F.col("nx").cast("bigint").alias("n50"))


def length_percentiles(df: DataFrame, length: str = "length", by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, read_count, p1 … p99)``, exact at any size."""
    stats = order_statistics(tally(df, {"length": F.col(length)}, by), by, tuple(PERCENTILES.values()))
    return stats.select(
        *by,
        F.col("n").alias("read_count"),
        *[F.col("quantiles")[i].alias(name) for i, name in enumerate(PERCENTILES)],
    )


def histograms_of_tally(
    counts: DataFrame,
    widths: Mapping[str, float],
    by: Sequence[str] = ("file",),
    scaled: bool = False,
) -> DataFrame:
    """``(*by, metric, start, end, count)`` from bin 0 to the last one in use, empty bins included.

    One histogram per metric in ``widths``; other metrics are left out only after counting, for
    the tally not to be filtered. ``scaled`` counts each value with its own weight (bases
    instead of reads).
    """
    keys = [*by, "metric"]
    for width in widths.values():
        if width <= 0:
            raise ValueError(f"bin_width must be > 0, got {width}")
    width = F.lit(None).cast("double")
    for name, w in widths.items():
        width = F.when(F.col("metric") == name, F.lit(float(w))).otherwise(width)
    weight = F.col("n") * F.col("value").cast("bigint") if scaled else F.col("n")
    place = F.when(F.col("value") < 0, F.lit(0)).otherwise(F.floor(F.col("value") / width))
    binned = (
        counts.withColumn("idx", F.when(width.isNotNull(), place))
        .groupBy(*keys, "idx")
        .agg(F.sum(weight).alias("count"), F.max(width).alias("width"))
        .where(F.col("width").isNotNull())
    )
    last = binned.groupBy(*keys).agg(F.max("idx").alias("last"), F.max("width").alias("width"))
    zero = F.lit(0).cast("bigint")
    empty = last.select(*keys, F.explode(F.sequence(zero, "last")).alias("idx"), zero.alias("count"), "width")
    return (
        binned.unionByName(empty)
        .groupBy(*keys, "idx")
        .agg(F.sum("count").alias("count"), F.max("width").alias("width"))
        .select(
            *keys,
            (F.col("idx") * F.col("width")).alias("start"),
            ((F.col("idx") + 1) * F.col("width")).alias("end"),
            "count",
        )
    )


def histogram(
    df: DataFrame, value: str, bin_width: float, by: Sequence[str] = ("file",), scaled: bool = False
) -> DataFrame:
    counts = tally(df, {"value": F.col(value)}, by)
    return histograms_of_tally(counts, {"value": bin_width}, by, scaled).drop("metric")


def length_histogram(
    df: DataFrame, length: str = "length", bin_width: float = LENGTH_BIN, by: Sequence[str] = ("file",), scaled: bool = False
) -> DataFrame:
    return histogram(df, length, bin_width, by, scaled)


def qscore_histogram(
    df: DataFrame, qscore: str = "qscore", bin_width: float = QSCORE_BIN, by: Sequence[str] = ("file",)
) -> DataFrame:
    return histogram(df, qscore, bin_width, by)


def histogram_arrays(hists: DataFrame, by: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """One row per input with the bins of each metric as an ordered array; for report sinks only."""
    bins = F.struct("start", "end", "count")
    return hists.groupBy(*by).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("metric") == m, bins))).alias(name) for m, name in names.items()]
    )
