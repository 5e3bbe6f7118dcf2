"""Statistics on alignments: counts, identity, MAPQ, flags, error rates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlens.functions import alignments as sam
from strandlens.functions import cigar as cg
from strandlens.functions import reads as fn
from strandlens.operators.distribution import LENGTH_BIN, histograms_of_tally, order_statistics, tally
from strandlens.operators.joins import join_on, with_inputs


def tag(name: str) -> Column:
    return F.col("tags")[F.lit(name)]


def reads_from_alignments(aln: DataFrame) -> DataFrame:
    """Reads as sequenced: secondary and supplementary records and those without a sequence dropped, reverse ones turned back."""
    back = sam.has_any(F.col("flag"), sam.REVERSE)
    sequenced = ~sam.has_any(F.col("flag"), sam.SECONDARY | sam.SUPPLEMENTARY) & F.col("seq").isNotNull()
    return aln.where(sequenced).select(
        "file",
        F.monotonically_increasing_id().alias("rec"),
        F.col("qname").alias("read_id"),
        F.when(back, fn.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"),
        F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"),
    )


def filter_alignments(aln: DataFrame, min_mapq: int = 0, exclude_flags: int = sam.DEPTH_EXCLUDE) -> DataFrame:
    """Drops records with any bit of ``exclude_flags``, then those below ``min_mapq``."""
    kept = aln.where(~sam.has_any(F.col("flag"), exclude_flags)) if exclude_flags else aln
    return kept.where(F.col("mapq") >= min_mapq) if min_mapq > 0 else kept


def aligned(aln: DataFrame) -> DataFrame:
    """Mapped, not secondary: the records lengths and identities are taken from."""
    return aln.where(~sam.has_any(F.col("flag"), sam.UNMAPPED | sam.SECONDARY))


def alignment_measures(aln: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, flag, mapq, length, identity)``; length is without soft clips."""
    summed = aln.select(
        *by,
        "flag",
        "mapq",
        cg.cigar_summary(F.col("cigar")).alias("c"),
        tag("NM").try_cast("bigint").alias("nm"),
        tag("de").try_cast("double").alias("de"),
    )
    return summed.select(
        *by,
        "flag",
        "mapq",
        cg.read_length_of_cigar(F.col("c")).alias("length"),
        cg.identity(F.col("c"), F.col("nm"), F.col("de")).alias("identity"),
    )


def alignment_tally(aln: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Flags of all records; lengths, identities and MAPQ of aligned ones; from one scan."""
    counted = ~sam.has_any(F.col("flag"), sam.UNMAPPED | sam.SECONDARY)
    measures = {name: F.when(counted, F.col(name)) for name in ("length", "identity", "mapq")}
    return tally(alignment_measures(aln, by), {"flag": F.col("flag"), **measures}, by)


def alignment_stats_of_tally(counts: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    flag = F.col("value").cast("int")

    def records(condition: Column | None = None) -> Column:
        chosen = F.col("metric") == "flag"
        return F.sum(F.when(chosen if condition is None else chosen & condition, F.col("n")).otherwise(0))

    classes = counts.groupBy(*by).agg(
        records().alias("total_reads"),
        records(~sam.has_any(flag, sam.UNMAPPED)).alias("mapped"),
        records(sam.has_any(flag, sam.UNMAPPED)).alias("unmapped"),
        records(sam.flag_class(flag) == "primary").alias("primary"),
        records(sam.has_any(flag, sam.SECONDARY)).alias("secondary"),
        records(sam.has_any(flag, sam.SUPPLEMENTARY)).alias("supplementary"),
    )

    def of(metric: str, value: Column) -> Column:
        return F.max(F.when(F.col("metric") == metric, value))

    shape = order_statistics(counts, by).groupBy(*by).agg(
        of("length", F.col("mean")).alias("mean_length"),
        of("length", F.col("quantiles")[0]).alias("median_length"),
        of("length", F.col("nx").cast("bigint")).alias("n50"),
        of("identity", F.col("mean")).alias("mean_identity"),
        of("identity", F.col("quantiles")[0]).alias("median_identity"),
    )
    return join_on(classes, shape, by, "left")


def alignment_stats(aln: DataFrame, by: Sequence[str] = ("file",), files: DataFrame | None = None) -> DataFrame:
    """Record counts by class; mean and median length and identity, N50 of aligned records.

    ``files`` adds zero counts for inputs without a record.
    """
    counts = ["total_reads", "mapped", "unmapped", "primary", "secondary", "supplementary"]
    return with_inputs(alignment_stats_of_tally(alignment_tally(aln, by), by), by, files, counts)


def alignment_length_histogram(
    aln: DataFrame, bin_width: float = LENGTH_BIN, by: Sequence[str] = ("file",), scaled: bool = False
) -> DataFrame:
    """Aligned lengths in bins; ``scaled`` counts bases instead of records."""
    counts = tally(alignment_measures(aligned(aln), by), {"length": F.col("length")}, by)
    return histograms_of_tally(counts, {"length": bin_width}, by, scaled).drop("metric")


def mapq_histogram(aln: DataFrame, by: Sequence[str] = ("file",), scaled: bool = False) -> DataFrame:
    """``(*by, start, end, count)`` per mapping quality; ``scaled`` counts aligned bases."""
    if scaled:
        rows, weight = alignment_measures(aligned(aln), by), F.sum("length")
    else:
        rows, weight = aligned(aln), F.count("*")
    return (
        rows.groupBy(*by, "mapq")
        .agg(weight.alias("count"))
        .select(*by, F.col("mapq").cast("double").alias("start"), (F.col("mapq") + 1).cast("double").alias("end"), "count")
    )


def flag_histogram(aln: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    return aln.groupBy(*by, "flag").agg(F.count("*").alias("count"))


def _for_errors(aln: DataFrame) -> DataFrame:
    return aln.where(~sam.has_any(F.col("flag"), sam.UNMAPPED | sam.SECONDARY | sam.SUPPLEMENTARY))


def error_tally(aln: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, kind, cycle, n)`` of primary records: all that error rates and cycles are made of, from one pass over cigar and MD.

    Each Arrow batch is counted by numpy, so a row of the shuffle stands for a cycle of a batch. ``kind`` is one of ``ERROR_KINDS``.
    """
    by = list(by)
    back = sam.has_any(F.col("flag"), sam.REVERSE)
    narrow = _for_errors(aln).select(
        *by, F.col("cigar").alias("_cigar"), tag("MD").alias("_md"), tag("NM").try_cast("bigint").alias("_nm"), back.alias("_back")
    )
    zero = F.lit(0).cast("bigint")
    schema = narrow.select(*by, F.lit("").alias("kind"), zero.alias("cycle"), zero.alias("n")).schema

    def run(batches):
        kinds = pa.array(cg.ERROR_KINDS)
        for batch in batches:
            seen: dict[tuple, int] = {}
            rows = zip(*(batch.column(b).to_pylist() for b in by), strict=True) if by else ((),) * batch.num_rows
            groups = np.fromiter((seen.setdefault(r, len(seen)) for r in rows), np.int64, batch.num_rows)
            group, kind, cycle, n = cg.count_errors(groups, *(batch.column(c) for c in ("_cigar", "_md", "_nm", "_back")))
            labels = list(zip(*seen, strict=True)) if seen else [()] * len(by)
            columns = [pa.array(labels[i], batch.schema.field(b).type).take(pa.array(group)) for i, b in enumerate(by)]
            columns += [kinds.take(pa.array(kind)), pa.array(cycle), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, [*by, "kind", "cycle", "n"])

    return narrow.mapInArrow(run, schema).groupBy(*by, "kind", "cycle").agg(F.sum("n").alias("n"))


def _of_kind(*kinds: str) -> Column:
    # without filters, so that all uses of a tally share its shuffle
    return F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))


def error_rates_of_tally(counts: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    sums = counts.groupBy(*by).agg(
        F.count_if(F.col("kind") == "edits").alias("known"), *[_of_kind(k).alias(k) for k in ("bases", "inserted", "deleted", "edits")]
    )
    bases = F.nullif(F.col("bases"), F.lit(0))
    return sums.where("known > 0").select(
        *by,
        ((F.col("edits") - F.col("inserted") - F.col("deleted")) / bases).alias("mismatch_rate"),
        (F.col("inserted") / bases).alias("insertion_rate"),
        (F.col("deleted") / bases).alias("deletion_rate"),
        (F.col("edits") / bases).alias("error_rate"),
    )


def error_rates(aln: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, mismatch_rate, insertion_rate, deletion_rate, error_rate)`` of primary records with NM.

    All are sums over the bases mapped by the cigar (M, =, X and I); mismatches are NM less
    inserted and deleted bases.
    """
    return error_rates_of_tally(error_tally(aln, by), by)


def mismatch_by_cycle(aln: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, cycle, mismatches, reads, rate)`` for each cycle any read with MD reaches."""
    return cycles_of_tally(error_tally(aln, by), by).withColumnRenamed("events", "mismatches")


def errors_by_cycle(aln: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, cycle, errors, reads, rate)``: mismatches, inserted bases and deletions together."""
    return cycles_of_tally(error_tally(aln, by), by, with_gaps=True).withColumnRenamed("events", "errors")


def cycles_of_tally(counts: DataFrame, by: Sequence[str] = ("file",), with_gaps: bool = False) -> DataFrame:
    """``(*by, cycle, events, reads, rate)``; the reads at a cycle come from the read ends."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    events = _of_kind("mismatch", "gap") if with_gaps else _of_kind("mismatch")
    summed = counts.groupBy(*by, "cycle").agg(events.alias("events"), _of_kind("end").alias("ends"), _of_kind("mismatch", "gap", "end").alias("any"))
    per_cycle = summed.where(F.col("any") > 0).drop("any")
    last = per_cycle.groupBy(*by).agg(F.max("cycle").alias("last"))
    every = last.select(*by, F.explode(F.sequence(one, "last")).alias("cycle"), zero.alias("events"), zero.alias("ends"))
    sums = (F.sum("events").alias("events"), F.sum("ends").alias("ends"))
    full = per_cycle.unionByName(every).groupBy(*by, "cycle").agg(*sums)
    # rows here are cycles, at most the length of the longest read per input
    longest_first = Window.partitionBy(*by).orderBy(F.desc("cycle")).rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("reads", F.sum("ends").over(longest_first)).select(
        *by, "cycle", "events", "reads", (F.col("events") / F.col("reads")).alias("rate")
    )


def insert_size_histogram(aln: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, insert_size, count)`` over first reads of proper pairs."""
    first = sam.has_all(F.col("flag"), sam.PAIRED | sam.PROPER_PAIR | sam.FIRST_OF_PAIR)
    kept = _for_errors(aln).where(first & (F.col("tlen") != 0))
    return kept.groupBy(*by, F.abs("tlen").alias("insert_size")).agg(F.count("*").alias("count"))
