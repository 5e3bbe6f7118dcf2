"""Depth of coverage.

Depth is a sweep over block borders (+1 where a block starts, -1 where it ends). Blocks are
first cut at the borders of fixed tiles, so each tile starts at depth 0 and tiles are
independent: a long chromosome spreads over thousands of tasks. Borders are summed per
position before they go to their tile, so a tile holds at most one row per position, no
matter how many reads pile up there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlens.functions import alignments as sam
from strandlens.functions import cigar as cg
from strandlens.functions.reads import gc_count
from strandlens.functions.regions import quantize_label
from strandlens.operators.alignments import filter_alignments
from strandlens.operators.distribution import order_statistics
from strandlens.operators.joins import join_on

TILE = 1 << 16
FRAMES = 1 << 12


def aligned_blocks(
    aln: DataFrame,
    by: Sequence[str] = ("file",),
    fast_mode: bool = False,
    min_mapq: int = 0,
    exclude_flags: int = sam.DEPTH_EXCLUDE,
) -> DataFrame:
    """``(*by, contig, start, end)`` of bases that count for depth.

    ``fast_mode`` takes one block per record over its whole reference span.
    """
    kept = filter_alignments(aln, min_mapq, exclude_flags)
    if fast_mode:
        span = kept.select(*by, "contig", F.col("pos").alias("start"), cg.cigar_summary(F.col("cigar"))["ref_span"].alias("span"))
        return span.where(F.col("span") > 0).select(*by, "contig", "start", (F.col("start") + F.col("span")).alias("end"))
    return kept.select(*by, "contig", F.inline(cg.block_array(F.col("cigar"), F.col("pos"))))


def tiles_of(start: Column, end: Column, tile: int) -> Column:
    """Numbers of the tiles that a half-open interval touches."""
    return F.sequence(F.floor(start / tile).cast("bigint"), F.floor((end - 1) / tile).cast("bigint"))


def cut_at_tiles(intervals: DataFrame, tile: int) -> DataFrame:
    """Adds ``tile`` and cuts ``start``/``end`` to it."""
    at = F.col("tile") * tile
    return intervals.withColumn("tile", F.explode(tiles_of(F.col("start"), F.col("end"), tile))).withColumns(
        {"start": F.greatest("start", at), "end": F.least("end", at + tile)}
    )


def base_depth(
    blocks: DataFrame,
    by: Sequence[str] = ("file",),
    tile: int = TILE,
    refs: DataFrame | None = None,
    only_tiles: DataFrame | None = None,
    merge: bool = True,
) -> DataFrame:
    """``(*by, contig, start, end, depth)`` as runs of equal depth.

    With ``refs`` (``*by, contig, length``) stretches of depth 0 are included, else left out.
    ``only_tiles`` (``contig, tile``) keeps the sweep to some tiles. Without ``merge`` runs are
    cut at tile borders, which sums over runs do not mind.
    """
    keys = [*by, "contig"]
    cut = cut_at_tiles(blocks.where(F.col("start") < F.col("end")), tile)
    if only_tiles is not None:
        cut = cut.join(only_tiles, ["contig", "tile"], "left_semi")
    one = F.lit(1).cast("bigint")
    borders = cut.select(
        *keys,
        "tile",
        F.inline(
            F.array(
                F.struct(F.col("start").alias("pos"), one.alias("delta")),
                F.struct(F.col("end").alias("pos"), (-one).alias("delta")),
            )
        ),
    )
    # one shuffle of borders, the same with ``refs`` and without, so that two sweeps of a report share it
    summed = borders.groupBy(*keys, "tile", "pos").agg(F.sum("delta").alias("delta"))
    if refs is None:
        summed = summed.where(F.col("delta") != 0)
    else:
        zero = F.lit(0).cast("bigint")
        ends = cut_at_tiles(
            refs.where(F.col("length") > 0).select(*keys, zero.alias("start"), F.col("length").alias("end")), tile
        )
        if only_tiles is not None:
            ends = ends.join(only_tiles, ["contig", "tile"], "left_semi")
        ends = ends.select(*keys, "tile", F.explode(F.array("start", "end")).alias("pos"), zero.alias("delta"))
        summed = summed.unionByName(ends).groupBy(*keys, "tile", "pos").agg(F.sum("delta").alias("delta"))
    sweep = Window.partitionBy(*keys, "tile").orderBy("pos")
    runs = summed.select(
        *keys,
        "tile",
        F.col("pos").alias("start"),
        F.lead("pos").over(sweep).alias("end"),
        F.sum("delta").over(sweep.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"),
    ).where(F.col("end").isNotNull() & (F.lit(refs is not None) | (F.col("depth") > 0)))
    if not merge:
        return runs.drop("tile")
    if refs is not None:  # a border of sum 0 inside a tile parts runs of equal depth
        runs = _islands(runs, [*keys, "tile"], "depth")
    return _merge_over_tiles(runs, keys, "depth", tile)


def _islands(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Joins runs that touch and have the same value, within ``keys``."""
    ordered = Window.partitionBy(*keys).orderBy("start")
    goes_on = (F.lag("end").over(ordered) == F.col("start")) & F.lag(value).over(ordered).eqNullSafe(F.col(value))
    return (
        runs.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island", value)
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_island")
    )


def _merge_over_tiles(runs: DataFrame, keys: Sequence[str], value: str, tile: int) -> DataFrame:
    """Joins runs across tile borders. Only rows at a border, two per tile, are put in order."""
    columns = [*keys, "start", "end", value]
    at_border = (F.col("start") % tile == 0) | (F.col("end") % tile == 0)
    inside = runs.where(~at_border).select(*columns)
    return inside.unionByName(_islands(runs.where(at_border).select(*columns), keys, value).select(*columns))


def coverage_by_contig(
    blocks: DataFrame, refs: DataFrame, by: Sequence[str] = ("file",)
) -> DataFrame:
    """``(*by, contig, length, mean_depth)`` for every contig of ``refs``; needs no sweep."""
    bases = blocks.groupBy(*by, "contig").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    return _mean_by_contig(bases, refs, by)


def coverage_of_histogram(per_contig: DataFrame, refs: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """The same from the depth histograms of contigs, where a sweep was made anyway."""
    bases = per_contig.groupBy(*by, "contig").agg(F.sum(F.col("depth") * F.col("bases")).alias("bases"))
    return _mean_by_contig(bases, refs, by)


def _mean_by_contig(bases: DataFrame, refs: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, "contig"]
    return join_on(refs.select(*keys, "length"), bases, keys, "left").select(
        *keys,
        "length",
        F.coalesce(F.coalesce(F.col("bases"), F.lit(0)) / F.nullif(F.col("length"), F.lit(0)), F.lit(0.0)).alias("mean_depth"),
    )


def depth_histogram(
    depth: DataFrame, by: Sequence[str] = ("file",), per_contig: bool = False
) -> DataFrame:
    """``(*by[, contig], depth, bases)``."""
    keys = [*by, "contig"] if per_contig else list(by)
    return depth.groupBy(*keys, "depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def depth_statistics(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, median_depth, min_depth, max_depth)`` over the bases of a depth histogram."""
    counts = hist.select(
        *keys, F.lit("depth").alias("metric"), F.col("depth").cast("double").alias("value"), F.col("bases").alias("n")
    )
    return order_statistics(counts, keys).select(
        *keys,
        F.col("quantiles")[0].alias("median_depth"),
        F.col("low").cast("bigint").alias("min_depth"),
        F.col("high").cast("bigint").alias("max_depth"),
    )


def median_depth(depth: DataFrame, by: Sequence[str] = ("file",), per_contig: bool = True) -> DataFrame:
    """``(*by[, contig], median_depth, min_depth, max_depth)``; give depth with its zeros."""
    keys = [*by, "contig"] if per_contig else list(by)
    return depth_statistics(depth_histogram(depth, by, per_contig), keys)


def coverage_summary(by_contig: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, mean_depth, mean_depth_unweighted)``: weighted by length, and plain mean of contigs.

    Without any length the plain mean stands for both.
    """
    plain = F.coalesce(F.avg("mean_depth"), F.lit(0.0))
    return by_contig.groupBy(*by).agg(
        F.coalesce(
            F.sum(F.col("mean_depth") * F.col("length")) / F.nullif(F.sum("length"), F.lit(0)), plain
        ).alias("mean_depth"),
        plain.alias("mean_depth_unweighted"),
    )


def low_coverage(by_contig: DataFrame, threshold: float | None, by: Sequence[str] = ("file",)) -> DataFrame:
    """Contigs below ``threshold`` as regions ``0..length``; none when the threshold is null."""
    chosen = F.col("mean_depth") < float(threshold) if threshold is not None else F.lit(False)
    return by_contig.where(chosen).select(
        *by, "contig", F.lit(0).cast("bigint").alias("start"), F.coalesce("length", F.lit(0)).cast("bigint").alias("end"), "mean_depth"
    )


def window_coverage(
    blocks: DataFrame, refs: DataFrame, window: int, by: Sequence[str] = ("file",)
) -> DataFrame:
    """``(*by, contig, start, end, mean_depth)`` per fixed window; the last one ends with its contig.

    Blocks are cut at window borders and summed, so no sweep over positions is needed.
    """
    if isinstance(window, bool) or not isinstance(window, int) or window <= 0:
        raise ValueError(f"window must be a whole number > 0, got {window!r}")
    keys = [*by, "contig"]
    zero = F.lit(0).cast("bigint")
    covered = cut_at_tiles(blocks.where(F.col("start") < F.col("end")), window).groupBy(*keys, "tile").agg(
        F.sum(F.col("end") - F.col("start")).alias("bases")
    )
    # contigs are cut coarsely first, so that their many small frames are made by many tasks
    tasks = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coarse = cut_at_tiles(
        refs.where(F.col("length") > 0).select(*keys, zero.alias("start"), F.col("length").alias("end")), window * FRAMES
    )
    frames = cut_at_tiles(coarse.repartition(tasks, *keys, "tile").drop("tile"), window)
    return join_on(frames, covered, [*keys, "tile"], "left").select(
        *keys, "start", "end", (F.coalesce("bases", zero) / (F.col("end") - F.col("start"))).alias("mean_depth")
    )


def quantized_coverage(
    blocks: DataFrame, refs: DataFrame, bins: str, by: Sequence[str] = ("file",), tile: int = TILE
) -> DataFrame:
    """``(*by, contig, start, end, label)``: neighbouring bases whose depth is in the same bin."""
    keys = [*by, "contig"]
    runs = base_depth(blocks, by, tile, refs, merge=False).select(
        *keys,
        F.floor(F.col("start") / tile).alias("tile"),
        "start",
        "end",
        quantize_label(F.col("depth"), bins).alias("label"),
    )
    merged = _islands(runs.where(F.col("label").isNotNull()), [*keys, "tile"], "label")
    return _merge_over_tiles(merged, keys, "label", tile)


def gc_coverage(
    aln: DataFrame,
    refs: DataFrame,
    window: int = 100,
    by: Sequence[str] = ("file",),
    min_mapq: int = 0,
    exclude_flags: int = sam.DEPTH_EXCLUDE,
) -> DataFrame:
    """``(*by, gc_pct, windows, mean_depth)``: depth of windows by the GC of reads starting there.

    The reads' own GC stands in for the reference sequence, which is not an input.
    """
    keys = [*by, "contig"]
    kept = filter_alignments(aln, min_mapq, exclude_flags)
    gc = (
        kept.where(F.col("seq").isNotNull())
        .withColumn("start", F.floor(F.col("pos") / window) * window)
        .groupBy(*keys, "start")
        .agg(
            F.sum(gc_count(F.col("seq"))).alias("gc"),
            F.sum(F.length("seq")).alias("bases"),
        )
        .where(F.col("bases") > 0)
    )
    blocks = aligned_blocks(aln, by, False, min_mapq, exclude_flags)
    return (
        join_on(window_coverage(blocks, refs, window, by), gc, [*keys, "start"])
        .groupBy(*by, F.round(100.0 * F.col("gc") / F.col("bases"), 1).alias("gc_pct"))
        .agg(F.count("*").alias("windows"), F.avg("mean_depth").alias("mean_depth"))
    )
