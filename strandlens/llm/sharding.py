"""Sharding by minimax contiguous partition of atomic groups, in DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL_BITS = 12
FETCH_GROUPS = 20_000
BUCKETS = 4096


@dataclass(frozen=True)
class Segment:
    """Groups whose key lies from ``low`` to ``high``, both included, in the order of keys."""

    low: int
    high: int
    size: int
    groups: int
    largest: int


def _fill(segments: list[Segment], start: int, capacity: int) -> int:
    """The end of the longest run of whole segments from ``start`` that fits."""
    held = 0
    while start < len(segments) and held + segments[start].size <= capacity:
        held += segments[start].size
        start += 1
    return start


def _feasible(segments: list[Segment], capacity: int, shards: int, start: int = 0) -> bool:
    for _ in range(shards):
        start = _fill(segments, start, capacity)
    return start == len(segments)


def smallest_capacity(segments: list[Segment], shards: int, low: int) -> int:
    """The smallest capacity from ``low`` on with which ``shards`` runs of whole segments hold all."""
    high = max(low, sum(s.size for s in segments))
    while low < high:
        middle = (low + high) // 2
        if _feasible(segments, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def _open(segments: list[Segment], shards: int) -> list[int]:
    """Segments of several groups in which a greedy cut for the smallest capacity may fall.

    That capacity is at least the fair share and the largest group, and at most what whole segments
    need. Each of its cuts lies at or after the greedy cut of whole segments with the least capacity,
    and beyond the last cut but one plus that capacity (two neighbours together exceed it); and it
    lies before the cut of divisible segments with the most capacity.
    """
    total = sum(s.size for s in segments)
    least = max(-(-total // shards), max((s.largest for s in segments), default=0))
    most = smallest_capacity(segments, shards, least)
    begins = [0]
    for s in segments:
        begins.append(begins[-1] + s.size)

    def down(place: int) -> int:
        return max((b for b in begins if b <= place), default=0)

    lows, high, found = [0], 0, set()
    for j in range(shards - 1):
        low = max(lows[-1], down(lows[-1] + least), lows[-2] + least if j else 0)
        lows.append(low)
        high = min(total, high + most)
        found.update(i for i, s in enumerate(segments) if s.groups > 1 and begins[i] <= high and begins[i + 1] >= low)
    return sorted(found)


def _balanced_starts(segments: list[Segment], shards: int, capacity: int) -> list[int]:
    """First segments of the shards after the first: near the fair share, never above ``capacity``."""
    starts, at, left = [], 0, sum(s.size for s in segments)
    for rest in range(shards - 1, 0, -1):
        greedy = _fill(segments, at, capacity)
        fair = min(greedy, _fill(segments, at, left // (rest + 1)))
        if fair < greedy:
            held = sum(s.size for s in segments[at:fair])
            fair += abs(held + segments[fair].size - left / (rest + 1)) < abs(left / (rest + 1) - held)
        end = fair if _feasible(segments, capacity, rest, fair) else greedy
        left -= sum(s.size for s in segments[at:end])
        at = end
        starts.append(at)
    return starts


def _summary(rows: DataFrame, level: int, ranges: list[tuple[int, int]] | None) -> list[Segment]:
    """Sums of groups by the first bits of their keys; ``level`` 64 bits: each group by itself."""
    if ranges is not None:
        inside = F.lit(False)
        for low, high in ranges:
            inside = inside | F.col("key").between(low, high)
        rows = rows.where(inside)
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    prefix = F.shiftright("key", 64 - level) if level < 64 else F.col("key")
    found = (
        groups.groupBy(prefix.alias("prefix"))
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups"), F.max("size").alias("largest"))
        .collect()
    )
    width = 64 - level
    return sorted(
        (Segment(r.prefix << width, ((r.prefix + 1) << width) - 1, r.size, r.groups, r.largest) for r in found),
        key=lambda s: s.low,
    )


def minimax_starts(rows: DataFrame, shards: int) -> tuple[list[int], int]:
    """Keys at which the shards after the first begin, and the capacity; ``rows``: key, size.

    Groups lie in the order of their keys. The driver sees sums by the first 12 bits of the keys (at
    most 4096), refined only where a cut may fall, by 12 more bits at a time and at last by group, when
    few are left: the search is exact, though the groups are never collected.
    """
    level = LEVEL_BITS
    segments = _summary(rows, level, None)
    while found := _open(segments, shards):
        level = 64 if level >= 60 or sum(segments[i].groups for i in found) <= FETCH_GROUPS else level + LEVEL_BITS
        ranges: list[tuple[int, int]] = []
        for i in found:
            if ranges and ranges[-1][1] + 1 == segments[i].low:
                ranges[-1] = (ranges[-1][0], segments[i].high)
            else:
                ranges.append((segments[i].low, segments[i].high))
        finer = _summary(rows, level, ranges)
        segments = sorted([s for i, s in enumerate(segments) if i not in set(found)] + finer, key=lambda s: s.low)
    least = max(
        -(-sum(s.size for s in segments) // shards), max((s.largest for s in segments), default=0)
    )
    capacity = smallest_capacity(segments, shards, least)
    starts = [segments[i].low if i < len(segments) else None for i in _balanced_starts(segments, shards, capacity)]
    return [s for s in starts if s is not None], capacity


def shard_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8, keep_row: bool = False
) -> DataFrame:
    """Puts documents into ``shards`` shards of near equal bytes; equal texts stay together.

    The law is ``bytes``: groups of equal texts lie in the order of a 64-bit hash, and are cut where
    the largest shard is as small as it can be for that order. Below that capacity, cuts are put close
    to equal shares.

    Returns ``doc_id``, ``size`` (UTF-8 bytes plus 1; null text: 1), ``text_crc32`` (null for null),
    ``law``, ``shard``, ``slot`` (from 0 without gaps in each shard) and ``grown_shard`` (null), and with
    ``keep_row`` the struct ``row`` of the input. Null texts form one group, empty ones another. Equal
    rows get different slots. Fewer groups than shards leave shards empty; an empty table gives no
    rows. Other columns are not read, whatever their names.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.col(text)).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("key"),
        *([F.struct("*").alias("row")] if keep_row else []),
    )
    starts, _ = minimax_starts(rows.select("key", "size"), shards)
    shard: Column = F.lit(0)
    for start in starts:
        shard = shard + F.when(F.col("key") >= F.lit(start), 1).otherwise(0)
    dealt = rows.withColumn("shard", shard.cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(29), "doc_id", "text_crc32"), F.lit(BUCKETS))
    )
    # slots: numbers within small buckets, plus the rows of the buckets before (at most 4096 a shard)
    before = Window.partitionBy("at_shard").orderBy("at_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(F.col("shard").alias("at_shard"), F.col("bucket").alias("at_bucket"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("at_shard", "at_bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "key", "size")
    return (
        dealt.withColumn("number", F.row_number().over(within))
        .join(F.broadcast(offsets), (F.col("shard") == F.col("at_shard")) & (F.col("bucket") == F.col("at_bucket")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("number") - 1).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            *(["row"] if keep_row else []),
        )
    )
