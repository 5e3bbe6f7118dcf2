"""Joins of intervals by overlap, and coverage of target regions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlens.functions.regions import region_name
from strandlens.operators.depth import TILE, base_depth, tiles_of
from strandlens.operators.joins import join_on
from strandlens.session import BROADCAST_MAX_ROWS, is_small

BIN = 1 << 14
ROWS_PER_SALT = 10_000
INPUTS_PER_BLOCK = 10_000
LEVEL_BITS, LEVELS = 3, 21
THRESHOLDS = (1, 10, 20)


def _first_bin(start: Column, bin_size: int) -> Column:
    """Number of the smallest bin at a position; what lies below 0 counts as 0."""
    return F.floor(F.greatest(start, F.lit(0)) / bin_size).cast("bigint")


def bin_level(start: Column, end: Column, bin_size: int) -> Column:
    """Level of the smallest bin that holds a whole interval: bins of the next level are 8 times as wide."""
    apart = _first_bin(start, bin_size).bitwiseXOR(_first_bin(end - 1, bin_size))
    return reduce(lambda a, b: a + b, [(F.shiftright(apart, LEVEL_BITS * i) != 0).cast("int") for i in range(LEVELS)])


def _bin_at(start: Column, level: Column, bin_size: int) -> Column:
    return F.call_function("shiftright", _first_bin(start, bin_size), level * LEVEL_BITS)


def _filed(right: DataFrame, bin_size: int, up_to: int) -> DataFrame:
    """Right intervals in the bins that hold them (``_of`` 0), and in those around it up to level ``up_to`` (1)."""
    level = bin_level(F.col("r_start"), F.col("r_end"), bin_size)
    places = F.array(F.struct(F.lit(0).alias("_of"), F.col("_own").alias("_level")))
    if up_to > 0:
        above = F.when(F.col("_own") < up_to, F.sequence(F.col("_own") + 1, F.lit(up_to)))
        above = F.coalesce(above, F.array().cast("array<int>"))
        places = F.concat(places, F.transform(above, lambda n: F.struct(F.lit(1).alias("_of"), n.alias("_level"))))
    rows = right.withColumn("_own", level).withColumn("_at", F.explode(places)).select("*", "_at._of", "_at._level").drop("_at", "_own")
    return rows.withColumn("_bin", _bin_at(F.col("r_start"), F.col("_level"), bin_size))


def _probes(left: DataFrame, bin_size: int, levels: list[int], up_to: int) -> DataFrame:
    """Left intervals in their own bin and those around it where right ones are filed (``_of`` 0), and in their own for smaller right ones (1)."""
    level = bin_level(F.col("start"), F.col("end"), bin_size)
    looked = F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col("_own"))
    places = F.transform(looked, lambda n: F.struct(F.lit(0).alias("_of"), n.alias("_level")))
    if up_to > 0:
        own = F.array(F.struct(F.lit(1).alias("_of"), F.col("_own").alias("_level")))
        places = F.when(F.col("_own") > 0, F.concat(places, own)).otherwise(places)
    rows = left.withColumn("_own", level).withColumn("_at", F.explode(places)).select("*", "_at._of", "_at._level").drop("_at", "_own")
    return rows.withColumn("_bin", _bin_at(F.col("start"), F.col("_level"), bin_size))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] = ("contig",),
    bin_size: int = BIN,
    broadcast_rows: int = BROADCAST_MAX_ROWS,
    left_salts: int = 1,
    left_level: int | None = None,
    count_left: bool = False,
) -> DataFrame:
    """All pairs of half-open intervals that overlap, as an equi-join over nested bins.

    Both sides have ``on``, ``start`` and ``end``; the right one's come out as ``r_start`` and ``r_end``. Each interval is filed in
    the smallest bin that holds it, however long it is: bins are ``bin_size`` wide on the first level, 8 times as wide on each
    further one. Of two that overlap one lies in a bin around that of the other, so either the left one finds the right one's bin
    among those around its own, or the other way round: each pair comes out once. Levels in which nothing is filed
    are not looked at.

    ``right`` is broadcast only if it was counted to be small; otherwise both sides are shuffled, and bins with many right
    rows are split over several tasks. ``count_left`` counts the left rows of each bin as well and splits full ones; ``left_salts``
    splits the left side of every bin by a fixed number. ``left_level`` is the highest level of a left interval where that is
    known; else one pass over the left side finds it.
    """
    on = list(on)
    named = right.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    used = named.agg(F.collect_set(bin_level(F.col("r_start"), F.col("r_end"), bin_size))).first()[0]
    if left_level is None:
        left_level = left.agg(F.max(bin_level(F.col("start"), F.col("end"), bin_size))).first()[0] or 0
    keyed, probe = _filed(named, bin_size, left_level), _probes(left, bin_size, sorted(used), left_level)
    keys = [*on, "_of", "_level", "_bin"]
    if is_small(keyed, broadcast_rows):
        keyed = F.broadcast(keyed)
    else:
        # the bins in use prune the left side, and tell over how many salts a full bin is split;
        # few enough, as for most genomes, they are broadcast, so that no full bin is shuffled unsplit
        bins = keyed.groupBy(*keys).agg(F.ceil(F.count("*") / ROWS_PER_SALT).cast("int").alias("_salts"))
        if count_left:
            piled = probe.groupBy(*keys).agg(F.ceil(F.count("*") / ROWS_PER_SALT).cast("int").alias("_lefts"))
            bins = bins.join(piled, keys)
        else:
            bins = bins.withColumn("_lefts", F.lit(left_salts))
        if is_small(bins, broadcast_rows):
            bins = F.broadcast(bins)
        which = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]) if count_left else F.spark_partition_id()
        keyed = (
            keyed.join(bins, keys)
            .withColumn("_salt", F.pmod(F.xxhash64("r_start", "r_end"), F.col("_salts")).cast("int"))
            .withColumn("_left", F.explode(F.sequence(F.lit(0), F.col("_lefts") - 1)))
            .drop("_salts", "_lefts")
        )
        probe = (
            probe.join(bins, keys)
            .withColumn("_left", F.pmod(which, F.col("_lefts")).cast("int"))
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
            .drop("_salts", "_lefts")
        )
        keys = [*keys, "_salt", "_left"]
    return (
        probe.join(keyed, keys)
        .where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
        .drop("_of", "_level", "_bin", "_salt", "_left")
    )


def _running_totals(left: DataFrame, points: DataFrame, on: list[str], tile: int) -> DataFrame:
    """``(*on, pos, started, ended, bases)`` at each point: intervals that start before it, that end at or before it, and their bases before it.

    Borders are summed per position first. Running totals are then taken inside tiles, and over the sums of tiles, of which there
    is one row for every ``tile`` bases at most, however many intervals there are.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    backwards = F.raise_error(F.lit("an interval ends before it starts")).cast("bigint")
    end = F.when(F.col("end") >= F.col("start"), F.col("end").cast("bigint")).otherwise(backwards)
    borders = left.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select(
        *on,
        F.inline(
            F.array(
                F.struct(F.col("start").cast("bigint").alias("pos"), one.alias("up"), zero.alias("down")),
                F.struct(end.alias("pos"), zero.alias("up"), one.alias("down")),
            )
        ),
        F.lit(False).alias("_asked"),
    )
    asked = points.select(*on, "pos", zero.alias("up"), zero.alias("down"), F.lit(True).alias("_asked"))
    rows = (
        borders.unionByName(asked)
        .groupBy(*on, "pos")
        .agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.max("_asked").alias("_asked"))
        .withColumn("_tile", F.floor(F.col("pos") / tile).cast("bigint"))
        .withColumn("_off", F.col("pos") - F.col("_tile") * tile)
    )

    def sum_over(window, value) -> Column:
        return F.coalesce(F.sum(value).over(window), zero)

    earlier = (Window.unboundedPreceding, -1)
    tiles = rows.groupBy(*on, "_tile").agg(
        F.sum("up").alias("t_up"), F.sum("down").alias("t_down"), F.sum((F.col("up") - F.col("down")) * F.col("_off")).alias("t_off")
    )
    along = Window.partitionBy(*on).orderBy("_tile")
    tiles = tiles.select(
        *on,
        "_tile",
        "t_up",
        "t_down",
        "t_off",
        sum_over(along.rowsBetween(*earlier), "t_up").alias("up_before"),
        sum_over(along.rowsBetween(*earlier), "t_down").alias("down_before"),
        ((F.lead("_tile").over(along) - F.col("_tile")) * tile).alias("_gap"),
    )
    # bases between the first position of this tile and that of the next one in use
    open_after = F.col("up_before") + F.col("t_up") - F.col("down_before") - F.col("t_down")
    tiles = tiles.withColumn("_step", open_after * F.col("_gap") - F.col("t_off")).select(
        *on, "_tile", "up_before", "down_before", sum_over(along.rowsBetween(*earlier), "_step").alias("bases_before")
    )
    inside = Window.partitionBy(*on, "_tile").orderBy("pos")
    until = inside.rowsBetween(Window.unboundedPreceding, 0)
    offs = (F.col("up") - F.col("down")) * F.col("_off")
    rows = rows.select(
        *on,
        "_tile",
        "pos",
        "_asked",
        "_off",
        sum_over(inside.rowsBetween(*earlier), "up").alias("_up"),
        sum_over(until, "down").alias("_down"),
        sum_over(until, F.col("up") - F.col("down")).alias("_open"),
        sum_over(until, offs).alias("_offs"),
    )
    open_here = F.col("up_before") - F.col("down_before") + F.col("_open")
    return rows.where("_asked").join(tiles, [*on, "_tile"]).select(
        *on,
        "pos",
        (F.col("up_before") + F.col("_up")).alias("started"),
        (F.col("down_before") + F.col("_down")).alias("ended"),
        (F.col("bases_before") + open_here * F.col("_off") - F.col("_offs")).alias("bases"),
    )


def overlap_sums(left: DataFrame, right: DataFrame, on: Sequence[str] = ("contig",), tile: int = TILE, bin_size: int = BIN) -> DataFrame:
    """The right intervals that any left one overlaps, with ``overlaps``, their number, and ``bases``, the sum of overlapped bases.

    As ``overlap_join`` and a sum over its pairs would give, but no pair is formed: both numbers are differences of running totals at the
    ends of a right interval, so the work grows with the intervals of both sides, however many overlap each other. No left interval
    may end before it starts. Right ones that hold no base are taken through ``overlap_join``.
    """
    on = list(on)
    named = right.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    for c in ("r_start", "r_end"):
        named = named.withColumn(c, F.col(c).cast("bigint"))
    wide = named.where(F.col("r_start") < F.col("r_end"))
    totals = _running_totals(left, wide.select(*on, F.explode(F.array("r_start", "r_end")).alias("pos")).distinct(), on, tile)
    first = totals.select(*on, F.col("pos").alias("r_start"), "ended", F.col("bases").alias("_bases"))
    last = totals.select(*on, F.col("pos").alias("r_end"), "started", "bases")
    sums = (
        wide.join(first, [*on, "r_start"])
        .join(last, [*on, "r_end"])
        .select(*named.columns, (F.col("started") - F.col("ended")).alias("overlaps"), (F.col("bases") - F.col("_bases")).alias("bases"))
        .where(F.col("overlaps") > 0)
    )
    bare = named.where(F.col("r_start") >= F.col("r_end"))
    if not bare.isEmpty():
        copies = left.groupBy(*on, "start", "end").agg(F.count("*").alias("_n"))
        spans = bare.select(*on, F.col("r_start").alias("start"), F.col("r_end").alias("end")).distinct()
        shared = F.least("end", "r_end") - F.greatest("start", "r_start")
        keys = [*on, "r_start", "r_end"]
        found = overlap_join(copies, spans, on, bin_size).groupBy(*keys).agg(F.sum("_n").alias("overlaps"), F.sum(F.col("_n") * shared).alias("bases"))
        sums = sums.unionByName(bare.join(found, keys))
    return sums.withColumnsRenamed({"r_start": "start", "r_end": "end"})


def region_tiles(regions: DataFrame, tile: int = TILE) -> DataFrame | None:
    """``(contig, tile)`` touched by any region, to prune a sweep by broadcast.

    None if these are too many: regions all over a large genome leave nothing to prune, and
    a shuffled join would put all reads of a deep tile into one task.
    """
    tiles = regions.select("contig", F.explode(tiles_of(F.col("start"), F.col("end"), tile)).alias("tile")).distinct()
    return F.broadcast(tiles) if is_small(tiles) else None


def attach_region_names(region_depth: DataFrame, bed: DataFrame) -> DataFrame:
    """Adds ``region_name`` by exact coordinates: the last BED row of a region names it, else the default."""
    names = bed.groupBy("contig", "start", "end").agg(
        F.max_by(F.coalesce("name", region_name(F.col("contig"), F.col("start"), F.col("end"))), "line_no").alias("region_name")
    )
    return region_depth.join(names, ["contig", "start", "end"], "left").withColumn(
        "region_name", F.coalesce("region_name", region_name(F.col("contig"), F.col("start"), F.col("end")))
    )


def attach_thresholds(region_depth: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Left join of threshold columns by exact coordinates."""
    return region_depth.join(thresholds, [*by, "contig", "start", "end"], "left")


def _region_runs(
    blocks: DataFrame, regions: DataFrame, by: Sequence[str], tile: int, bin_size: int, broadcast_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Distinct regions, empty ones too, and the runs of depth inside each as ``(*by, contig, r_start, r_end, bases, depth)``."""
    spans = regions.select("contig", "start", "end").distinct()
    wide = spans.where(F.col("start") < F.col("end"))
    depth = base_depth(blocks, by, tile, only_tiles=region_tiles(wide, tile), merge=False)
    # runs end at tile borders, so a level whose bins are whole tiles holds them all
    level = next((i for i in range(LEVELS) if (bin_size << LEVEL_BITS * i) % tile == 0), None)
    pairs = overlap_join(depth, wide, ("contig",), bin_size, broadcast_rows, left_level=level)
    inside = pairs.withColumn("bases", F.least("end", "r_end") - F.greatest("start", "r_start"))
    return spans, inside.select(*by, "contig", "r_start", "r_end", "bases", "depth")


def _per_input(spans: DataFrame, inputs: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Every region for every input: inputs in blocks, and each region sent to each block."""
    if not by:
        return spans
    listed = inputs.select(*by).distinct()
    blocks = -(-listed.count() // INPUTS_PER_BLOCK) or 1
    dealt = listed.withColumn("_block", F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int"))
    sent = spans.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return sent.join(F.broadcast(dealt) if is_small(dealt) else dealt, "_block").select(*by, *spans.columns)


def _region_sums(
    blocks: DataFrame,
    regions: DataFrame,
    by: Sequence[str],
    inputs: DataFrame | None,
    thresholds: Sequence[int],
    tile: int,
    bin_size: int,
    broadcast_rows: int,
) -> DataFrame:
    """``(*by, contig, start, end, covered, total, low, high, at_{t} …)`` of every region and input."""
    if by and inputs is None:
        raise ValueError("inputs is needed to report regions without reads per input")
    keys = [*by, "contig", "r_start", "r_end"]
    spans, inside = _region_runs(blocks, regions, by, tile, bin_size, broadcast_rows)
    sums = {
        "covered": F.sum("bases"),
        "total": F.sum(F.col("bases") * F.col("depth")),
        "high": F.max("depth"),
        **{f"at_{t}": F.sum(F.when(F.col("depth") >= t, F.col("bases")).otherwise(0)) for t in thresholds},
    }
    found = inside.groupBy(*keys).agg(*[c.alias(name) for name, c in sums.items()], F.min("depth").alias("low"))
    every = _per_input(spans.withColumnsRenamed({"start": "r_start", "end": "r_end"}), inputs, by)
    zero = F.lit(0).cast("bigint")
    return join_on(every, found, keys, "left").select(
        *by,
        "contig",
        F.col("r_start").alias("start"),
        F.col("r_end").alias("end"),
        "low",
        *[F.coalesce(name, zero).alias(name) for name in sums],
    )


def targeted_coverage(
    blocks: DataFrame,
    regions: DataFrame,
    by: Sequence[str] = ("file",),
    inputs: DataFrame | None = None,
    thresholds: Sequence[int] = THRESHOLDS,
    tile: int = TILE,
    bin_size: int = BIN,
    broadcast_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Mean, minimum and maximum depth of each region, and the percent of its bases at each threshold.

    ``inputs`` (``*by``) lists the inputs to report on, those with no read in any region
    included; needed unless ``by`` is empty. Depth is swept only in tiles that regions touch. A region
    without a base (its end not above its start) has no mean and no percentages, and depths of 0.
    """
    sums = _region_sums(blocks, regions, by, inputs, thresholds, tile, bin_size, broadcast_rows)
    width = F.col("end") - F.col("start")
    bases = F.when(width > 0, width)
    return sums.select(
        *by,
        "contig",
        "start",
        "end",
        (F.col("total") / bases).alias("mean_depth"),
        F.when(F.col("covered") == bases, F.col("low")).otherwise(0).cast("bigint").alias("min_depth"),
        F.col("high").alias("max_depth"),
        *[(100.0 * F.col(f"at_{t}") / bases).alias(f"pct_coverage_{t}x") for t in thresholds],
    )


def threshold_coverage(
    blocks: DataFrame, regions: DataFrame, thresholds: Sequence[int] = THRESHOLDS, by: Sequence[str] = ("file",), **options
) -> DataFrame:
    """``(*by, contig, start, end, pct_coverage_{t}x …)``."""
    report = targeted_coverage(blocks, regions, by, thresholds=thresholds, **options)
    return report.drop("mean_depth", "min_depth", "max_depth")


def bedcov(
    blocks: DataFrame,
    regions: DataFrame,
    by: Sequence[str] = ("file",),
    inputs: DataFrame | None = None,
    tile: int = TILE,
    bin_size: int = BIN,
    broadcast_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """``(*by, contig, start, end, bases)``: sum of depth over each region.

    Taken from the runs of depth, not from the blocks: a bin holds at most one run per base,
    however many reads lie there.
    """
    sums = _region_sums(blocks, regions, by, inputs, (), tile, bin_size, broadcast_rows)
    return sums.select(*by, "contig", "start", "end", F.col("total").alias("bases"))
