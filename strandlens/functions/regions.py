"""Regions: location strings, names, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlens.functions.text import safe_int

# Snapshot file types.
SNAPSHOT_TYPES = ("png", "svg")


def parse_location(location: Column) -> Column:
    """``chr:start-end[:name]`` to ``struct(contig, start, end, name)``.

    Cut at ``:`` and then at the first ``-``; coordinates stay as written and the name is the
    whole string, so a contig name must not hold a colon. Wrong input raises an error.
    """
    parts = F.split(location, ":")
    span = F.get(parts, F.lit(1))
    shaped = (F.size(parts) >= 2) & F.contains(span, F.lit("-"))
    start = safe_int(F.substring_index(span, "-", 1))
    end = safe_int(F.substring(span, F.locate("-", span) + 1, F.length(span)))

    def checked(number: Column) -> Column:
        return (
            F.when(
                ~F.coalesce(shaped, F.lit(False)),
                F.raise_error(F.concat(F.lit("A location is written contig:start-end, not "), location)),
            )
            .when(number.isNull(), F.raise_error(F.concat(F.lit("Start and end must be whole numbers in location "), location)))
            .otherwise(number)
        ).cast("bigint")

    return F.struct(
        F.get(parts, F.lit(0)).alias("contig"),
        checked(start).alias("start"),
        checked(end).alias("end"),
        location.alias("name"),
    )


def region_name(contig: Column, start: Column, end: Column) -> Column:
    """Default name ``contig:start-end``."""
    return F.concat(contig, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def snapshot_name(name: Column, contig: Column, start: Column, end: Column, extension: str = "png") -> Column:
    """File name of a region: its name, else the default with ``:`` and ``-`` as ``_``; right extension."""
    if extension not in SNAPSHOT_TYPES:
        raise ValueError(f"extension must be one of {SNAPSHOT_TYPES}, got {extension!r}")
    others = "|".join(t for t in SNAPSHOT_TYPES if t != extension)
    plain = F.coalesce(F.when(name != "", name), F.translate(region_name(contig, start, end), ":-", "__"))
    return F.when(F.lower(plain).endswith(f".{extension}"), plain).otherwise(
        F.concat(F.regexp_replace(plain, rf"(?i)\.({others})$", ""), F.lit(f".{extension}"))
    )


def expand_region(start: Column, end: Column, min_width: int) -> tuple[Column, Column]:
    """Pad evenly to ``min_width``, an odd base on the right; the start may become negative."""
    missing = F.lit(min_width) - (end - start)
    keep = (F.lit(min_width) <= 0) | (missing <= 0)
    left = F.floor(missing / 2).cast("bigint")
    return F.when(keep, start).otherwise(start - left), F.when(keep, end).otherwise(end + missing - left)


def quantize_label(depth: Column, bins: str) -> Column:
    """Label ``low:high`` of the bin of ``depth``; ``bins`` as in ``0:1:10:30:100:`` (open end)."""
    edges = parse_bins(bins)
    label = F.lit(None).cast("string")
    for low, high in reversed(edges):
        inside = depth >= low if high is None else (depth >= low) & (depth < high)
        label = F.when(inside, F.lit(f"{low}:{'inf' if high is None else high}")).otherwise(label)
    return label


def parse_bins(bins: str) -> list[tuple[int, int | None]]:
    parts = bins.split(":")
    try:
        low = [int(p) for p in parts if p != ""]
    except ValueError as exc:
        raise ValueError(f"Invalid quantize bins: {bins!r}") from exc
    if len(low) < 1 or sorted(set(low)) != low or "" in parts[1:-1]:
        raise ValueError(f"Invalid quantize bins: {bins!r}")
    if parts[0] == "":
        low.insert(0, 0)
    high: list[int | None] = list(low[1:])
    if parts[-1] == "":
        high.append(None)
    return list(zip(low, high))
