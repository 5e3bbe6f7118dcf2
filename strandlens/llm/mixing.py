"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlens.llm.common import broadcast_if_small, word_count, written

BLOCK_WORDS = 32
MIN_TARGET_BLOCKS = 64
SHARD_WORDS = 50_000
MAX_SHARDS = 4096


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients ``weight / (2 k + 1)``, none above its cap; ties to the first.

    A divisor near the last winning quotient gives all but a few seats at once; the rest are handed
    out (or taken back) one by one. Seats beyond the sum of the caps are not given.
    """
    weights, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    caps = np.where(weights > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)

    def given(divisor: float) -> np.ndarray:
        # a seat k is won while weight / (2 k + 1) > divisor
        k = np.ceil(np.maximum(weights / divisor - 1, 0) / 2)
        return np.minimum(k, caps).astype(np.int64)

    low, high = weights[weights > 0].min() / (2.0 * caps.max() + 3), weights.max() * 1.01
    for _ in range(200):
        mid = (low + high) / 2
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    # just above the last divisor, so that equal quotients are left for the ordered part
    out = given(high * (1 + 1e-9))
    heap = [(-weights[i] / (2 * out[i] + 1), i) for i in np.flatnonzero(out < caps)]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def source_targets(sizes: DataFrame, source: str, max_epochs: int) -> DataFrame:
    """One row per source: weights 1, 2, 3 repeating by code point order (null last) share all words.

    A target stops at ``max_epochs`` times its source; the excess goes to the others by weight. With
    the sources ordered by limit per weight, those before the first one that its share does not fill
    are at their limits. ``sizes`` has one row per source, so its windows are short.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    by_limit = Window.orderBy("limit_each", "position").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = (
        sizes.withColumn("position", F.row_number().over(by_name))
        .withColumn("weight", ((F.col("position") - 1) % 3 + 1).cast("double"))
        .withColumn("limit", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("limit_each", F.col("limit") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(by_limit), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("left_weight"))
    )
    level = F.min(F.when(F.col("level") <= F.col("limit_each") * (1 + 1e-12), F.struct("limit_each", "position", "level")))
    return rows.withColumn("target", F.least("limit", level.over(every)["level"] * F.col("weight"))).select(
        source, "source_size", "target"
    )


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 17,
    max_epochs: int = 3,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    keep_row: bool = False,
) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    The documents of a source are dealt to shards by a seeded hash (about ``shard_words`` words each,
    at most 4096 shards, so that a hot source is spread) and lie in seeded order in their shard, cut
    into blocks of ``block_words`` words, or of fewer if the smallest target is below ``MIN_TARGET_BLOCKS`` times
    that. Sainte-Laguë gives each source its number of blocks, then
    each shard of a source its quota. Full rounds of a quota take every block; what is left takes the
    first blocks in an order that begins at a seeded block, so most documents stay whole.

    Returns one row per row of ``docs``: ``doc_id``, ``source``, ``size`` (words), ``source_size``,
    ``target`` and ``source_taken`` are its source's, ``taken`` its own (0 to ``max_epochs`` times
    ``size``), and with ``keep_row`` the struct ``row`` of all input columns and the row's place, ``shard`` and ``begin``. Null and empty texts have
    size 0 and are never taken; the null source is a source; equal rows take equal places in any
    order; an empty table gives no rows; other columns are not read, whatever their names.
    """
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.crc32(F.col(text))).alias("place"),
        *([F.struct("*").alias("row")] if keep_row else []),
    )
    # one row per source: in one task, whatever the number of documents
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))

    def to_sources(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last").reset_index(drop=True)
        targets = rows["target"].to_numpy()
        # small enough for the smallest target to be met, down to one word
        block = int(np.clip(targets[targets > 0].min(initial=np.inf) / MIN_TARGET_BLOCKS, 1, block_words))
        blocks = np.ceil(rows["source_size"].to_numpy() / block).astype(np.int64)
        seats = round(rows["source_size"].sum() / block)
        rows["block"] = block
        rows["blocks"] = sainte_lague(targets, seats, blocks * max_epochs)
        return rows

    targets = written(
        source_targets(sizes, "source", max_epochs)
        .groupBy()
        .applyInPandas(to_sources, "source string, source_size bigint, target double, block bigint, blocks bigint")
        .withColumn(
            "n_shards", F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / shard_words)))
        ),
        "mix-targets",
    )
    known = broadcast_if_small(targets.withColumnRenamed("source", "of_source"))
    placed = base.join(known, F.col("source").eqNullSafe(F.col("of_source"))).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.col("n_shards")).cast("int")
    )

    def to_shards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard").reset_index(drop=True)
        words = rows["words"].to_numpy(np.int64)
        rows["shard_blocks"] = -(-words // rows["block"])
        rows["quota"] = sainte_lague(words, int(rows["blocks"].iloc[0]), rows["shard_blocks"].to_numpy() * max_epochs)
        return rows

    # at most 4096 rows per source
    quotas = written(
        placed.groupBy("source", "shard")
        .agg(F.sum("size").alias("words"), F.first("block").alias("block"), F.first("blocks").alias("blocks"))
        .groupBy("source")
        .applyInPandas(
            to_shards, "source string, shard int, words bigint, block bigint, blocks bigint, shard_blocks bigint, quota bigint"
        )
        .select("source", "shard", "words", "shard_blocks", "quota"),
        "mix-quotas",
    )
    in_place = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size")
    laid = placed.withColumn(
        "begin", F.sum("size").over(in_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    )
    cells = broadcast_if_small(quotas.select(F.col("source").alias("of"), F.col("shard").alias("at"), "words", "shard_blocks", "quota"))
    joined = laid.join(cells, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at")))

    def inside(begin: Column, end: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("begin") + F.col("size"), end) - F.greatest(F.col("begin"), begin))

    blocks = F.greatest(F.col("shard_blocks"), F.lit(1))
    rest = F.col("quota") % blocks
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), blocks)
    over = F.greatest(F.lit(0), first + rest - blocks)
    taken = (
        F.floor(F.col("quota") / blocks) * F.col("size")
        + inside(first * F.col("block"), F.least((first + rest) * F.col("block"), F.col("words")))
        + inside(F.lit(0), over * F.col("block"))
    ).cast("bigint")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *(["shard", "begin", "row"] if keep_row else [])
    )


def whole_copies(parts: list[tuple[int, int, int, int]], others: bool) -> list[tuple[int, int, int]]:
    """``(shard, begin, copies)`` of the documents of a source of which the mix takes no whole number of copies.

    ``parts`` has their ``(shard, begin, size, taken)``. Each gets the number of copies below or above its own,
    whichever leaves less of the words carried on from larger documents. If all get none and the source has no
    ``others``, the smallest gets one, so that no source with words taken is lost.
    """
    carry, out = 0, []
    for shard, begin, size, taken in sorted(parts, key=lambda p: (-p[2], p[0], p[1])):
        copies = taken // size
        left = carry + taken - copies * size
        if abs(left - size) < abs(left):
            copies, left = copies + 1, left - size
        carry = left
        out.append((shard, begin, copies))
    if out and not others and not any(c for _, _, c in out):
        out[-1] = (*out[-1][:2], 1)
    return out


def with_copies(mixed: DataFrame) -> DataFrame:
    """Adds ``copies`` to a mix with rows: whole numbers whose words add up to the words taken of each source.

    At most a few documents of each shard are taken in part; just their places are gathered by source.
    """
    size, taken = F.greatest("size", F.lit(1)), F.col("taken")
    broken = taken % size != 0
    place = F.struct("shard", "begin", "size", "taken")
    rounded = F.udf(whole_copies, "array<struct<shard: int, begin: bigint, copies: bigint>>")
    gathered = (
        mixed.groupBy("source")
        .agg(F.collect_list(F.when(broken, place)).alias("parts"), F.max(~broken & (taken > 0)).alias("others"))
        .select(F.col("source").alias("of"), F.inline(rounded("parts", "others")))
        .select("of", F.col("shard").alias("at"), F.col("begin").alias("from"), "copies")
    )
    known = broadcast_if_small(written(gathered, "mix-copies"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at")) & (F.col("begin") == F.col("from")) & broken
    return mixed.join(known, same, "left").withColumn("copies", F.coalesce("copies", F.floor(taken / size)).cast("int")).drop("of", "at", "from")
