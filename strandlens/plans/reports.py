"""One row per input with everything a report holds, for the JSON sink.

Lists in a report (bins, contigs, cycles) are as long as the report itself and are only
collected here, at the very end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlens.functions import reads as fn
from strandlens.functions.alignments import DEPTH_EXCLUDE
from strandlens.functions.regions import parse_location
from strandlens.operators import alignments as al
from strandlens.operators import depth as dp
from strandlens.operators import distribution as ds
from strandlens.operators import genes, overlap
from strandlens.operators import reads as rd
from strandlens.operators import runs as rn
from strandlens.operators import variants as vr
from strandlens.operators.joins import join_on
from strandlens.session import scratch_dir


def _list(df: DataFrame, by: Sequence[str], name: str, *fields: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def _nest(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return df.select(*by, F.struct(*[c for c in df.columns if c not in by]).alias(name))


def read_report(
    reads: DataFrame, by: Sequence[str] = ("file",), length_bin: float = ds.LENGTH_BIN, qscore_bin: float = ds.QSCORE_BIN
) -> DataFrame:
    """Read statistics with percentiles and both histograms. All from one tally of the reads."""
    counts = rd.read_tally(rd.read_metrics(reads, by), by)
    stats = rd.read_stats_of_tally(counts, by)
    shares = F.struct(*ds.PERCENTILES).alias("length_percentiles")
    hists = ds.histograms_of_tally(counts, {"length": length_bin, "qscore": qscore_bin}, by)
    arrays = ds.histogram_arrays(hists, by, {"length": "length_histogram", "qscore": "qscore_histogram"})
    return join_on(stats.select(*[c for c in stats.columns if c not in ds.PERCENTILES], shares), arrays, by, "left")


def read_length_distribution(reads: DataFrame, by: Sequence[str] = ("file",), bin_width: float = ds.LENGTH_BIN) -> DataFrame:
    """``(*by, percentiles, histogram)``; qualities are not looked at."""
    counts = ds.tally(reads, {"length": fn.read_length(F.col("seq"))}, by)
    stats = ds.order_statistics(counts, by, tuple(ds.PERCENTILES.values()))
    shares = F.struct(*[F.col("quantiles")[i].alias(name) for i, name in enumerate(ds.PERCENTILES)])
    hists = ds.histogram_arrays(ds.histograms_of_tally(counts, {"length": bin_width}, by), by, {"length": "histogram"})
    return join_on(stats.select(*by, shares.alias("percentiles")), hists, by, "left")


def qscore_distribution(
    reads: DataFrame, by: Sequence[str] = ("file",), bin_width: float = ds.QSCORE_BIN, per_position: bool = False
) -> DataFrame:
    """``(*by, mean_qscore, median_qscore, histogram, per_position_mean)``; the last one is null unless asked for."""
    counts = rd.qscore_tally(reads, by)
    stats = ds.order_statistics(counts, by).select(
        *by, F.col("mean").alias("mean_qscore"), F.col("quantiles")[0].alias("median_qscore")
    )
    hists = ds.histogram_arrays(ds.histograms_of_tally(counts, {"qscore": bin_width}, by), by, {"qscore": "histogram"})
    out = join_on(stats, hists, by, "left")
    if not per_position:
        return out.withColumn("per_position_mean", F.lit(None).cast("array<double>"))
    cycles = _list(rd.per_position_quality(reads, by), by, "c", "cycle", "mean_q")
    means = cycles.select(*by, F.transform("c", lambda x: x["mean_q"]).alias("per_position_mean"))
    return join_on(out, means, by, "left")


def alignment_read_lengths(aln: DataFrame, by: Sequence[str] = ("file",), bin_width: float = ds.LENGTH_BIN) -> DataFrame:
    """``read_length_distribution`` of the reads behind alignments: each once, as sequenced."""
    return read_length_distribution(al.reads_from_alignments(aln), by, bin_width)


def alignment_read_qscores(
    aln: DataFrame, by: Sequence[str] = ("file",), bin_width: float = ds.QSCORE_BIN, per_position: bool = False
) -> DataFrame:
    """``qscore_distribution`` of the reads behind alignments: each once, as sequenced."""
    return qscore_distribution(al.reads_from_alignments(aln), by, bin_width, per_position)


def run_report(runs: DataFrame, by: Sequence[str] = ("file",), files: DataFrame | None = None) -> DataFrame:
    """Run statistics with yield per hour; the list is empty when times are missing or all equal."""
    windows = _list(rn.yield_per_hour(runs, by), by, "yield_per_hour", "window_start_hours", "yield_bp", "read_count")
    return _empty_if_null(join_on(rn.run_stats(runs, by, files), windows, by, "left"), "yield_per_hour")


def _empty_if_null(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(name, F.array().cast(df.schema[name].dataType)))


_BINS = "array<struct<start:double,end:double,count:bigint>>"


def _bin(start: str | Column, end: Column, count: str | Column) -> Column:
    column = [F.col(c) if isinstance(c, str) else c for c in (start, end, count)]
    return F.struct(column[0].cast("double").alias("start"), column[1].cast("double").alias("end"), column[2].alias("count"))


def stage_alignments(aln: DataFrame, by: Sequence[str] = ("file",), with_seq: bool = False) -> DataFrame:
    """The columns that statistics need, written once to the shared scratch folder as Parquet.

    For text input that several reports will pass over: the text is then parsed once, and each
    pass reads just its columns. Sequences, most of the volume, go along only for GC.
    """
    columns = [*by, "contig", "pos", "flag", "mapq", "cigar", "tlen", *(["seq"] if with_seq else [])]
    tags = F.map_filter("tags", lambda k, _: k.isin("NM", "MD", "de")).alias("tags")
    path = scratch_dir(aln.sparkSession, "alignments")
    aln.select(*columns, tags).write.parquet(path)
    return aln.sparkSession.read.parquet(path)


def alignment_report(
    aln: DataFrame,
    by: Sequence[str] = ("file",),
    include_hist: bool = True,
    scaled: bool = False,
    include_mapq: bool = True,
    include_flags: bool = False,
    length_bin: float = ds.LENGTH_BIN,
) -> DataFrame:
    """Alignment statistics; histograms are null unless asked for, and then not computed either.

    All but the base-weighted MAPQ histogram come from one tally of the alignments.
    """
    counts = al.alignment_tally(aln, by)
    out = al.alignment_stats_of_tally(counts, by)
    parts: dict[str, DataFrame | None] = dict.fromkeys(
        ["length_histogram", "length_histogram_scaled", "mapq_histogram", "mapq_histogram_scaled", "flag_histogram"]
    )
    for name, wanted, weighted in (("length_histogram", include_hist, False), ("length_histogram_scaled", include_hist and scaled, True)):
        if wanted:
            hist = ds.histograms_of_tally(counts, {"length": length_bin}, by, weighted)
            parts[name] = ds.histogram_arrays(hist, by, {"length": name})
    listed = {"mapq_histogram": ("mapq", include_mapq), "flag_histogram": ("flag", include_flags)}
    for name, (metric, wanted) in listed.items():
        if wanted:
            item = F.when(F.col("metric") == metric, _bin("value", F.col("value") + 1, "n"))
            parts[name] = counts.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias(name))
    if include_mapq and scaled:
        parts["mapq_histogram_scaled"] = _list(
            al.mapq_histogram(aln, by, True), by, "mapq_histogram_scaled", "start", "end", "count"
        )
    for name, part in parts.items():
        out = out.withColumn(name, F.lit(None).cast(_BINS)) if part is None else join_on(out, part, by, "left")
    return out


def coverage_report(
    aln: DataFrame,
    refs: DataFrame,
    by: Sequence[str] = ("file",),
    low_cov_threshold: float | None = None,
    min_mapq: int = 0,
    exclude_flags: int = DEPTH_EXCLUDE,
    fast_mode: bool = False,
    with_distribution: bool = True,
    tile: int = dp.TILE,
) -> DataFrame:
    """Mean and median depth per input and contig, low contigs, depth distribution.

    Without ``with_distribution`` there is no sweep, and medians and distribution are null.
    """
    by_contig = [*by, "contig"]
    blocks = dp.aligned_blocks(aln, by, fast_mode, min_mapq, exclude_flags)
    if with_distribution:
        per_contig = dp.depth_histogram(dp.base_depth(blocks, by, tile, refs, merge=False), by, per_contig=True)
        contigs = dp.coverage_of_histogram(per_contig, refs, by)
    else:
        contigs = dp.coverage_by_contig(blocks, refs, by)
    out = dp.coverage_summary(contigs, by)
    if with_distribution:
        overall = per_contig.groupBy(*by, "depth").agg(F.sum("bases").alias("bases"))
        contigs = join_on(contigs, dp.depth_statistics(per_contig, by_contig).drop("min_depth", "max_depth"), by_contig, "left")
        out = join_on(out, dp.depth_statistics(overall, by).drop("min_depth", "max_depth"), by, "left")
        bins = overall.groupBy(*by).agg(
            F.sort_array(F.collect_list(_bin("depth", F.col("depth"), "bases"))).alias("coverage_distribution")
        )
        out = join_on(out, bins, by, "left")
    else:
        contigs = contigs.withColumn("median_depth", F.lit(None).cast("double"))
        out = out.withColumns(
            {"median_depth": F.lit(None).cast("double"), "coverage_distribution": F.lit(None).cast(_BINS)}
        )
    low = dp.low_coverage(contigs, low_cov_threshold, by)
    lists = {
        "coverage_by_contig": (contigs, ("contig", "length", "mean_depth", "median_depth")),
        "low_coverage_regions": (low, ("contig", "start", "end", "mean_depth")),
    }
    for name, (rows, fields) in lists.items():
        out = join_on(out, _list(rows, by, name, *fields), by, "left")
    return _empty_if_null(out, "low_coverage_regions")


def coverage_tables(
    aln: DataFrame,
    refs: DataFrame,
    by: Sequence[str] = ("file",),
    window: int | None = None,
    quantize: str | None = None,
    min_mapq: int = 0,
    exclude_flags: int = DEPTH_EXCLUDE,
    fast_mode: bool = False,
    tile: int = dp.TILE,
) -> dict[str, DataFrame]:
    """Coverage ``windows`` and ``quantized`` runs, as asked for.

    These grow with the genome, so they are tables and not lists in a report.
    """
    blocks = dp.aligned_blocks(aln, by, fast_mode, min_mapq, exclude_flags)
    tables = {}
    if window is not None:
        tables["windows"] = dp.window_coverage(blocks, refs, window, by)
    if quantize is not None:
        tables["quantized"] = dp.quantized_coverage(blocks, refs, quantize, by, tile)
    return tables


def error_report(aln: DataFrame, refs: DataFrame, by: Sequence[str] = ("file",), tile: int = dp.TILE) -> DataFrame:
    """Error rates with depth, GC, mismatch and insert size distributions; empty ones are null.

    Rates and cycles come from one tally: cigars and MD tags are walked once.
    """
    depth = dp.depth_histogram(dp.base_depth(dp.aligned_blocks(aln, by), by, tile, merge=False), by)
    counts = al.error_tally(aln, by)
    out = al.error_rates_of_tally(counts, by)
    for name, with_gaps in (("mismatch_by_cycle", False), ("error_by_position", True)):
        cycles = _list(al.cycles_of_tally(counts, by, with_gaps), by, "c", "cycle", "rate")
        out = join_on(out, cycles.select(*by, F.transform("c", lambda x: x["rate"]).alias(name)), by, "left")
    bins = {
        "coverage_histogram": (depth, "depth", "bases"),
        "gc_coverage": (dp.gc_coverage(aln, refs, by=by), "gc_pct", "windows"),
        "insert_size_histogram": (al.insert_size_histogram(aln, by), "insert_size", "count"),
    }
    for name, (rows, at, count) in bins.items():
        listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(_bin(at, F.col(at), count))).alias(name))
        out = join_on(out, listed, by, "left")
    return out


def alignment_summary(
    aln: DataFrame,
    refs: DataFrame,
    by: Sequence[str] = ("file",),
    include_coverage: bool = True,
    include_error_profile: bool = False,
    alignment_options: dict | None = None,
    coverage_options: dict | None = None,
    stage: bool = False,
) -> DataFrame:
    """``(*by, alignment, coverage, errors)`` as structs; a part not asked for is null and not computed.

    The parts pass over the alignments several times. For text input, ``stage`` writes the columns they
    need to the shared folder first; a narrow Parquet table needs no such copy.
    """
    if stage:
        aln = stage_alignments(aln, by, with_seq=include_error_profile)
    out = _nest(alignment_report(aln, by, **(alignment_options or {})), by, "alignment")
    parts = {
        "coverage": (include_coverage, lambda: coverage_report(aln, refs, by, **(coverage_options or {}))),
        "errors": (include_error_profile, lambda: error_report(aln, refs, by, (coverage_options or {}).get("tile", dp.TILE))),
    }
    for name, (wanted, build) in parts.items():
        if wanted:
            out = join_on(out, _nest(build(), by, name), by, "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out


def variant_report(variants: DataFrame, by: Sequence[str] = ("file",), include_snps: bool = True, include_indels: bool = True) -> DataFrame:
    """``(*by, general, snps, indels)``; a part not asked for is null."""
    stats = vr.variant_stats(variants, by)
    general = F.struct("total_records", "mnps", "others", "singletons")
    snps = F.struct(F.col("snps").alias("count"), "ts_tv_ratio")
    indels = F.struct(F.col("indels").alias("count"))
    return stats.select(
        *by,
        general.alias("general"),
        F.when(F.lit(include_snps), snps).alias("snps"),
        F.when(F.lit(include_indels), indels).alias("indels"),
    )


def target_regions(
    spark,
    gene: str | None = None,
    features: DataFrame | None = None,
    location: str | None = None,
    bed: DataFrame | None = None,
    one_based: bool = False,
) -> DataFrame:
    """``(line_no, contig, start, end, name)`` from exactly one of a gene, a location and BED intervals.

    Coordinates of a gene or location are taken as written unless ``one_based``.
    """
    given = [gene is not None, location is not None, bed is not None]
    if sum(given) == 0:
        raise ValueError("One of gene with features, location, or bed must be provided")
    if sum(given) > 1:
        raise ValueError("Only one of gene with features, location, or bed should be provided")
    shift = 1 if one_based else 0
    if bed is not None:
        return bed.select("line_no", "contig", "start", "end", "name")
    line = F.lit(1).cast("bigint").alias("line_no")
    if location is not None:
        spot = spark.range(1).select(parse_location(F.lit(location)).alias("r"))
        return spot.select(line, "r.contig", (F.col("r.start") - shift).alias("start"), "r.end", "r.name")
    if features is None:
        raise ValueError("features is required when gene is provided")
    found = genes.gene_regions(features, gene, (), one_based)
    if found.isEmpty():
        raise ValueError(f"Gene {gene!r} not found in annotation")
    return found.select(line, "contig", "start", "end", "name")


def combine_regions(*lists: DataFrame) -> DataFrame:
    """Regions of several requests as one list; on equal coordinates the later request names the region."""
    if not lists:
        raise ValueError("At least one region list is required")
    numbered = [
        df.select(F.struct(F.lit(i).alias("list"), F.col("line_no").alias("line")).alias("line_no"), "contig", "start", "end", "name")
        for i, df in enumerate(lists)
    ]
    out = numbered[0]
    for df in numbered[1:]:
        out = out.unionByName(df)
    return out


def targeted_coverage_report(
    aln: DataFrame,
    regions: DataFrame,
    by: Sequence[str] = ("file",),
    min_mapq: int = 0,
    exclude_flags: int = DEPTH_EXCLUDE,
    fast_mode: bool = False,
    **options,
) -> DataFrame:
    """Named coverage rows for ``target_regions``."""
    blocks = dp.aligned_blocks(aln, by, fast_mode, min_mapq, exclude_flags)
    inputs = options.pop("inputs", aln.select(*by).distinct() if by else None)
    return overlap.attach_region_names(overlap.targeted_coverage(blocks, regions, by, inputs, **options), regions)
