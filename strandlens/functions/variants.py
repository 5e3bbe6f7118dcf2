"""Classes of one ALT allele."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_class(ref: Column, alt: Column) -> Column:
    """snp, mnp, indel, other (symbolic, ``*``) or ref (``.`` or equal to REF)."""
    plain = alt.rlike("^[ACGTNacgtn]+$") & ref.rlike("^[ACGTNacgtn]+$")
    return (
        F.when((alt == ".") | (F.upper(alt) == F.upper(ref)), "ref")
        .when(~plain, "other")
        .when(F.length(ref) != F.length(alt), "indel")
        .when(F.length(ref) == 1, "snp")
        .otherwise("mnp")
    )


def titv_class(ref: Column, alt: Column) -> Column:
    """ts for A/G and C/T changes, tv for other single-base changes, else null."""
    change = F.upper(F.concat(ref, alt))
    return F.when(change.isin("AG", "GA", "CT", "TC"), "ts").when(
        change.rlike("^[ACGT]{2}$") & (F.upper(ref) != F.upper(alt)), "tv"
    )


def allele_counts(alts: Column, format_keys: Column, samples: Column) -> Column:
    """How often each ALT is carried over all genotypes, in ALT order; null without genotypes."""
    gt_at = F.array_position(format_keys, F.lit("GT")) - 1
    carried = F.flatten(
        F.transform(samples, lambda s: F.split(F.coalesce(F.get(F.split(s, ":"), gt_at.cast("int")), F.lit(".")), "[/|]"))
    )
    counts = F.transform(
        F.sequence(F.lit(1), F.size(alts)),
        lambda i: F.size(F.filter(carried, lambda a: a == i.cast("string"))).cast("bigint"),
    )
    return F.when((gt_at >= 0) & (F.size(samples) > 0) & (F.size(alts) > 0), counts)
