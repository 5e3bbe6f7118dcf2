"""SAM flag bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
PAIRED, PROPER_PAIR, UNMAPPED, REVERSE, FIRST_OF_PAIR = 1, 2, 4, 16, 64
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 256, 512, 1024, 2048

DEPTH_EXCLUDE = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE
"""Reads that do not count for depth unless another mask is given."""


def has_any(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(F.lit(mask)) != 0


def has_all(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(F.lit(mask)) == mask


def flag_class(flag: Column) -> Column:
    """unmapped, secondary, supplementary or primary."""
    return (
        F.when(has_any(flag, UNMAPPED), "unmapped")
        .when(has_any(flag, SECONDARY), "secondary")
        .when(has_any(flag, SUPPLEMENTARY), "supplementary")
        .otherwise("primary")
    )
