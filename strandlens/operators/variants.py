"""Statistics and filters on variants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlens.functions import variants as fn
from strandlens.operators.joins import with_inputs
from strandlens.operators.overlap import overlap_join

ENDLESS = 1 << 40


def with_allele_counts(variants: DataFrame) -> DataFrame:
    """Adds ``alt_counts``: carriers of each ALT over all genotypes, null without genotypes."""
    if "alt_counts" in variants.columns:
        return variants
    return variants.withColumn("alt_counts", fn.allele_counts(F.col("alts"), F.col("format"), F.col("samples")))


def _parsed_regions(regions: str, contigs: Sequence[str]) -> list[tuple[str, int, int]]:
    """``(contig, start, end)`` of each item, half-open and 0-based."""
    found = []
    for item in filter(None, (r.strip() for r in regions.split(","))):
        contig, colon, span = item.rpartition(":")
        if item in contigs or not colon:
            found.append((item, 0, ENDLESS))
            continue
        first, dash, last = span.partition("-")
        try:
            low = int(first)
            high = int(last) if last else ENDLESS if dash else low
        except ValueError as exc:
            raise ValueError(f"Invalid region: {item!r}") from exc
        found.append((contig, low - 1, high))
    if not found:
        raise ValueError(f"Invalid region list: {regions!r}")
    return found


def region_filter(variants: DataFrame, regions: str | DataFrame, contigs: Sequence[str] = ()) -> DataFrame:
    """Records that overlap a region with any base of their REF, each once.

    ``regions`` is a comma-separated list of ``chr``, ``chr:pos``, ``chr:from-`` or ``chr:from-to`` (1-based, both
    ends belong to the region), or a table of ``contig``, ``start``, ``end`` (0-based, half-open) of any size,
    which goes through the overlap join; bins full of variants or of regions are split. An item that is one of ``contigs`` is a whole contig, so
    that names may hold colons.
    """
    start = F.col("pos") - 1
    end = start + F.greatest(F.length("ref"), F.lit(1))
    if isinstance(regions, str):
        spans = _parsed_regions(regions, contigs)
        inside = [(F.col("chrom") == c) & (start < F.lit(high)) & (end > F.lit(low)) for c, low, high in spans]
        # the list of contigs by itself, which is pushed to the scan
        return variants.where(F.col("chrom").isin(*{c for c, _, _ in spans}) & reduce(Column.__or__, inside))
    # the join works on distinct spans; a record that meets several regions is kept once
    spans = variants.select(F.col("chrom").alias("contig"), start.alias("start"), end.alias("end")).distinct()
    hit = overlap_join(spans, regions.select("contig", "start", "end").where("start < end").distinct(), count_left=True)
    hit = hit.select(F.col("contig").alias("_contig"), F.col("start").alias("_start"), F.col("end").alias("_end")).distinct()
    same = (F.col("chrom") == F.col("_contig")) & (start == F.col("_start")) & (end == F.col("_end"))
    return variants.join(hit, same, "left_semi")


def sample_filter(variants: DataFrame, wanted: str | Sequence[str], sample_names: Column) -> DataFrame:
    """Only the wanted sample columns, only ALTs they carry, only records with such an ALT.

    ``sample_names`` is an array column (or literal) of all names in column order.
    """
    names = [s.strip() for s in wanted.split(",")] if isinstance(wanted, str) else list(wanted)
    if not names or not all(names):
        raise ValueError(f"Invalid sample list: {wanted!r}")
    chosen = F.transform(
        F.filter(F.arrays_zip(sample_names.alias("name"), F.col("samples").alias("call")), lambda x: x["name"].isin(*names)),
        lambda x: x["call"],
    )
    narrowed = variants.drop("alt_counts").withColumn("samples", chosen)
    counted = with_allele_counts(narrowed)
    carried = F.filter(
        F.arrays_zip(F.col("alts").alias("alt"), F.col("alt_counts").alias("n")), lambda x: F.coalesce(x["n"], F.lit(0)) > 0
    )
    return (
        counted.withColumn("_carried", carried)
        .where(F.size("_carried") > 0)
        .withColumns(
            {"alts": F.transform("_carried", lambda x: x["alt"]), "alt_counts": F.transform("_carried", lambda x: x["n"])}
        )
        .drop("_carried")
    )


def ts_tv_ratio(ts: Column, tv: Column) -> Column:
    """Null when both are 0, infinite when only tv is."""
    return F.when(tv > 0, ts / tv).when(ts > 0, F.lit(float("inf")))


def variant_stats(
    variants: DataFrame,
    by: Sequence[str] = ("file",),
    include_snps: bool = True,
    include_indels: bool = True,
    files: DataFrame | None = None,
) -> DataFrame:
    """Records, SNPs, indels, MNPs, others, transitions, transversions, singletons per input.

    A record counts for a class when any of its ALTs has it; ts and tv count SNP alleles and
    singletons alleles carried once. All within the row, so the one shuffle is of partial sums.
    ``files`` adds zero counts for inputs without a record.
    """
    rows = with_allele_counts(variants)
    classes = F.transform("alts", lambda a: fn.variant_class(F.col("ref"), a))
    changes = F.transform("alts", lambda a: fn.titv_class(F.col("ref"), a))
    marked = rows.select(
        *by,
        classes.alias("classes"),
        F.size(F.filter(changes, lambda c: c == "ts")).alias("ts"),
        F.size(F.filter(changes, lambda c: c == "tv")).alias("tv"),
        F.when(F.col("alt_counts").isNotNull(), F.size(F.filter("alt_counts", lambda n: n == 1))).alias("once"),
    )

    def records(kind: str) -> Column:
        return F.count_if(F.exists("classes", lambda c: c == kind))

    out = marked.groupBy(*by).agg(
        F.count("*").alias("total_records"),
        records("snp").alias("snps"),
        records("indel").alias("indels"),
        records("mnp").alias("mnps"),
        records("other").alias("others"),
        F.sum("ts").cast("bigint").alias("ts"),
        F.sum("tv").cast("bigint").alias("tv"),
        F.sum("once").cast("bigint").alias("singletons"),
    )
    out = with_inputs(out, by, files, ["total_records", "snps", "indels", "mnps", "others", "ts", "tv"])
    out = out.withColumn("ts_tv_ratio", ts_tv_ratio(F.col("ts"), F.col("tv")))
    if not include_snps:
        out = out.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in ("snps", "ts", "tv", "ts_tv_ratio")})
    if not include_indels:
        out = out.withColumn("indels", F.lit(None).cast("bigint"))
    return out
