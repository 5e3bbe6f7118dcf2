"""Exact top-k search with a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlens.llm.common import written
from strandlens.llm.vectors import matrix, usable

CELL_BITS = 6
QUERY_BLOCK = 1024
ROW_BLOCK = 4096
FIRST_READS = 16


def scaled(vector: Column, factor: int = 256) -> Column:
    """Integer components: the floor of each component times ``factor``, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


def _ranges(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest component of each dimension: ``width`` numbers each, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column("v"), np.int64, width)
                low = rows.min(0) if low is None else np.minimum(low, rows.min(0))
                high = rows.max(0) if high is None else np.maximum(high, rows.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high)], ["at", "low", "high"])

    found = vectors.select("v").mapInArrow(run, "at bigint, low bigint, high bigint")
    rows = found.groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()
    return np.array([r.low for r in rows], np.int64), np.array([r.high for r in rows], np.int64)


def _approximations(vectors: DataFrame, low: np.ndarray, step: np.ndarray, width: int) -> DataFrame:
    """The file: blocks of ids and cells, one byte a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(begin, ROW_BLOCK)
                cells = ((matrix(part.column("v"), np.int64, width) - low) // step).astype(np.uint8)
                ids = part.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary())], ["ids", "cells"])

    return vectors.select("id", "v").mapInArrow(run, "ids binary, cells binary")


def _query_blocks(queries: DataFrame, width: int, blocks: int, *more: str) -> DataFrame:
    """Queries in ``blocks`` blocks of about ``QUERY_BLOCK``: ids, vectors, and other numbers, packed."""

    def run(table: pa.Table) -> pa.Table:
        q = matrix(table.column("v").combine_chunks(), np.int64, width)
        columns = [pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([table.column("id").to_numpy().tobytes()], pa.binary())]
        columns += [pa.array([q.tobytes()], pa.binary()), *(pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in more)]
        return pa.table(columns, names=["block", "query_ids", "query_vectors", *more])

    schema = "block int, query_ids binary, query_vectors binary" + "".join(f", {c} binary" for c in more)
    placed = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select("block", "id", "v", *more)
    return placed.groupBy("block").applyInArrow(run, schema)


def _against(file: DataFrame, query_blocks: DataFrame, blocks: int, bytes_queries: int) -> DataFrame:
    """Every row block beside every query block: the stated queries against all rows, in blocks."""
    sent = file.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return sent.join(F.broadcast(query_blocks) if bytes_queries <= 32 << 20 else query_blocks, "block")


def _slack(low: np.ndarray, high: np.ndarray, query_low: np.ndarray, query_high: np.ndarray) -> float:
    """What bounds in double precision may be off: nothing while all sums stay below 2^53. Products that a long may not hold are refused."""
    rows = [max(-int(a), int(b)) for a, b in zip(low, high, strict=True)]
    asked = [max(-int(a), int(b)) for a, b in zip(query_low, query_high, strict=True)]
    largest = sum(r * q for r, q in zip(rows, asked, strict=True))
    if largest >= 1 << 62 or max(rows) >= 1 << 61:
        raise ValueError("Components are too large: a whole-number product may reach 2^62")
    return 0.0 if largest < 1 << 53 else float(largest) * (len(rows) + 8) * 2.0**-51 + 1


def _bounds(batch: pa.RecordBatch, i: int, low: np.ndarray, step: np.ndarray, width: int, slack: float):
    """Ids, and lower and upper bounds of all products of a row block with a query block."""
    ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
    cells = np.frombuffer(batch.column("cells")[i].as_py(), np.uint8).reshape(-1, width).astype(np.float64)
    query_ids = np.frombuffer(batch.column("query_ids")[i].as_py(), np.int64)
    q = np.frombuffer(batch.column("query_vectors")[i].as_py(), np.int64).reshape(-1, width).astype(np.float64)
    # whole numbers; where sums may pass 2^53, the bounds are widened by what double precision can lose
    bottom = cells * step + low
    positive, negative = np.maximum(q, 0), np.minimum(q, 0)
    base = q @ bottom.T
    spread = (step - 1).astype(np.float64)
    least = base + (negative @ spread)[:, None] - slack
    most = base + (positive @ spread)[:, None] + slack
    itself = query_ids[:, None] == ids[None, :]
    return ids, query_ids, np.where(itself, -np.inf, least), np.where(itself, -np.inf, most)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest integer inner product for each row of ``queries``.

    Both have ``id`` (bigint) and ``v`` (array of bigint, no nulls); a query does not find its own id. Of
    equal vectors only the ``k + 1`` smallest ids can be results, the rest is not compared. Cells of
    each component (6 bits) bound every product from both sides. A first scan finds the k-th best lower
    bound of each query, a second one the rows whose upper bound reaches it; their exact vectors are
    read in the order of the bounds until no unread bound can reach the k-th result.

    Returns ``query_id``, ``rank`` (from 1; ties by smaller id), ``vec_id`` and ``score``. Fewer rows than ``k``
    give fewer results; empty inputs give none; shorter vectors count as filled with zeros. Where sums can
    pass 2^53 the bounds are widened, so results stay exact; tables whose products may reach 2^62 are refused.
    """
    spark = vectors.sparkSession
    same = Window.partitionBy("v").orderBy("id")
    rows = written(
        vectors.select("id", "v").withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"), "va-rows"
    )
    asked = written(queries.select("id", "v"), "va-queries")
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    n_queries, most_wide = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not width or not n_queries:
        return empty
    width = max(width, most_wide)
    low, high = _ranges(rows, width)
    slack = _slack(low, high, *_ranges(asked, width))
    step = np.maximum((high - low) // (1 << CELL_BITS) + 1, 1)
    file = written(_approximations(rows, low, step, width), "va-file")
    blocks = -(-n_queries // QUERY_BLOCK)
    bytes_queries = n_queries * (width * 8 + 16)

    def best_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, query_ids, least, _ = _bounds(batch, i, low, step, width, slack)
                top = min(k, len(ids))
                best = -np.partition(-least, top - 1, axis=1)[:, :top]
                keep = np.isfinite(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query_ids, keep.sum(1))), pa.array(best[keep].astype(np.int64))], ["id", "bound"]
                )

    scan = _against(file, _query_blocks(asked, width, blocks), blocks, bytes_queries)
    bounds = scan.mapInArrow(best_bounds, "id bigint, bound bigint")
    by_bound = Window.partitionBy("id").orderBy(F.col("bound").desc())
    kth = (
        bounds.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= k).groupBy("id")
        .agg(F.when(F.count(F.lit(1)) >= k, F.min("bound")).otherwise(F.lit(-(1 << 62))).alias("floor"))
    )
    floored = written(asked.join(kth, "id"), "va-floors")

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, query_ids, _, most = _bounds(batch, i, low, step, width, slack)
                floor = np.frombuffer(batch.column("floor")[i].as_py(), np.int64)
                q, r = np.nonzero(np.isfinite(most) & (most >= floor[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[q]), pa.array(ids[r]), pa.array(most[q, r].astype(np.int64))], ["query_id", "vec_id", "bound"]
                )

    second = _against(file, _query_blocks(floored, width, blocks, "floor"), blocks, bytes_queries)
    in_order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "vec_id")
    candidates = written(
        second.mapInArrow(reaching, "query_id bigint, vec_id bigint, bound bigint").withColumn("place", F.row_number().over(in_order)),
        "va-candidates",
    )

    def scored(chosen: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("q", "v", lambda x, y: F.coalesce(x * y, F.lit(0))), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return (
            chosen.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id")
            .join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
            .select("query_id", "vec_id", product.alias("score"))
        )

    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # two steps in the order of the bounds: the second reads only what may still change the result
    reads = max(FIRST_READS, k)
    first = written(scored(candidates.where(F.col("place") <= reads)), "va-first")
    certain = (
        first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    )
    rest = candidates.where(F.col("place") > reads).join(certain, "query_id").where("bound >= kth")
    found = first.union(scored(rest)).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_scaled(embeddings: DataFrame, k: int, asked: Column, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``exact_top_k`` over the floors of 256 times each component; ``asked`` chooses the queries.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids.
    Other columns are not read, whatever their names.
    """
    whole = embeddings.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    rows = whole.select(F.col(vec_id).cast("bigint").alias("id"), scaled(F.col(vector)).alias("v"))
    return exact_top_k(rows, whole.where(asked).select(F.col(vec_id).cast("bigint").alias("id"), scaled(F.col(vector)).alias("v")), k)
