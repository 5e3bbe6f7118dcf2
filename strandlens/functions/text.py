"""Reading text fields: trimming, tolerant number parsing, key/value maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Drop white space at both ends, tabs included (empty outer columns vanish with it)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def columns_of(c: Column) -> Column:
    """Tab-separated fields of the stripped line."""
    return F.split(strip(c), "\t")


def safe_int(c: Column) -> Column:
    """Whole number or null; ``3.0`` is not a whole number, blanks around digits are fine."""
    return c.try_cast("bigint")


def safe_float(c: Column) -> Column:
    """Floating number or null. Java's ``1d``/``1f`` suffixes are not numbers here."""
    return F.when(~c.rlike(r"[0-9.][dDfF]\s*$"), c.try_cast("double"))


def map_last_wins(entries: Column) -> Column:
    """Map from an array of ``struct(key, value)``; a repeated key keeps its last value.

    Done here instead of by ``spark.sql.mapKeyDedupPolicy`` so that no session setting matters.
    """
    kept = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))),
            lambda later: later["key"] == e["key"],
        ),
    )
    # keys are hardly ever repeated, and looking for a later one of each takes quadratic time
    distinct = F.size(F.array_distinct(F.transform(entries, lambda e: e["key"]))) == F.size(entries)
    return F.map_from_entries(F.when(distinct, entries).otherwise(kept))


def pair(item: Column, sep: str) -> Column:
    """``struct(key, value)`` of an item, cut at the first separator."""
    at = F.locate(sep, item)
    return F.struct(
        F.substring(item, F.lit(1), at - 1).alias("key"),
        F.substring(item, at + 1, F.length(item)).alias("value"),
    )


def tag_map(items: Column) -> Column:
    """``K:V`` items to a map, cut at the first colon; items without one are skipped."""
    return map_last_wins(
        F.transform(F.filter(items, lambda x: F.contains(x, F.lit(":"))), lambda x: pair(x, ":"))
    )


def _angle_items(value: Column) -> Column:
    body = F.regexp_replace(value, r"^<(.*)>$", "$1")
    quoted = F.regexp_extract_all(body, F.lit(r'((?:\\"|"(?:\\"|[^"])*"|[^,"])+)'), 1)
    # without a quote, as in most lines on contigs, every comma cuts
    cut = F.when(F.contains(body, F.lit('"')), quoted).otherwise(F.split(body, ","))
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def has_angle_value(value: Column, key: str) -> Column:
    """Whether ``angle_map`` would give ``key`` a value that is not empty, without building the map."""
    named = F.filter(_angle_items(value), lambda x: (x == key) | F.startswith(x, F.lit(f"{key}=")))
    last = F.try_element_at(named, F.lit(-1))
    found = F.coalesce(F.regexp_replace(F.substring(last, len(key) + 2, 1 << 30), r'^"+|"+$', "") != "", F.lit(False))
    # most lines on contigs have no quote and begin with the key, which no later item has
    first = value.rlike(rf"^<{key}=(?![,\s]).+>\z") & ~F.contains(value, F.lit('"')) & ~value.rlike(rf",\s*{key}\s*[=,>]")
    return F.when(first, F.lit(True)).otherwise(found)


def angle_map(value: Column) -> Column:
    """``<k=v,k="a,b">`` to a map; commas inside quotes do not cut, outer quotes are dropped."""
    return map_last_wins(
        F.transform(
            _angle_items(value),
            lambda x: F.when(
                F.contains(x, F.lit("=")),
                F.struct(
                    F.substring_index(x, "=", 1).alias("key"),
                    F.regexp_replace(F.substring(x, F.locate("=", x) + 1, F.length(x)), r'^"+|"+$', "").alias("value"),
                ),
            ).otherwise(F.struct(x.alias("key"), F.lit("").alias("value"))),
        )
    )


def gff_attrs(value: Column) -> Column:
    """``k=v;k=v`` to a map with lower-case keys; values are kept as written."""
    items = F.filter(F.split(value, ";"), lambda x: F.contains(x, F.lit("=")))
    return map_last_wins(
        F.transform(
            items,
            lambda x: F.struct(
                F.lower(pair(x, "=")["key"]).alias("key"),
                pair(x, "=")["value"].alias("value"),
            ),
        )
    )


def has_control_chars(c: Column) -> Column:
    """Whether a region field has a C0, DEL or C1 control character."""
    return c.rlike(r"[\x00-\x1f\x7f-\x9f]")
