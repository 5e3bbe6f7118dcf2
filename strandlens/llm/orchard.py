"""Centroid clustering in whole numbers, with Orchard's search for the nearest centroid."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlens.llm.common import discard, written
from strandlens.llm.vectors import usable

MAX_CENTROIDS = 2048
"""Bound on the centroids, as each has a list of all others in every task: 48 MB in all."""

MAX_COMPONENT = 1 << 27
ROWS_AT_ONCE = 8192


@dataclass
class Centroids:
    """Centroids, and for each the others by distance: ``order`` their numbers, ``reach`` how near a row must be to skip them.

    A centroid that is strictly more than twice as far as the row cannot be as near to the row; in squares, more than
    four times. ``reach`` is the least squared distance of a row that cannot rule it out.
    """

    points: np.ndarray
    order: np.ndarray
    reach: np.ndarray

    @staticmethod
    def of(points: np.ndarray) -> Centroids:
        k = len(points)
        apart = np.empty((k, k), np.int64)
        for i in range(k):
            apart[i] = ((points - points[i]) ** 2).sum(axis=1)
            apart[i, i] = -1
        order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        return Centroids(points, order, (np.take_along_axis(apart, order, axis=1) + 3) // 4)


def nearest(rows: np.ndarray, centroids: Centroids, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (ties: the smaller number), and its squared distance.

    Each row begins at the centroid ``start`` and goes down that one's list. A nearer one, once met, takes over with its own list;
    centroids already compared are marked and passed by. It ends at the first list entry more than twice as far
    as the centroid held. Rows go along their lists together.
    """
    points, order, reach = centroids.points, centroids.order, centroids.reach
    n, k = len(rows), len(points)
    held = start.astype(np.int64)
    distance = ((rows - points[held]) ** 2).sum(axis=1)
    visited = np.zeros((n, k), bool)
    visited[np.arange(n), held] = True
    place = np.zeros(n, np.int64)
    active = np.arange(n)
    while True:
        active = active[place[active] < k - 1]
        active = active[distance[active] >= reach[held[active], place[active]]]
        if not len(active):
            return held, distance
        other = order[held[active], place[active]]
        place[active] += 1
        fresh = ~visited[active, other]
        at, other = active[fresh], other[fresh]
        visited[at, other] = True
        met = ((rows[at] - points[other]) ** 2).sum(axis=1)
        nearer = (met < distance[at]) | ((met == distance[at]) & (other < held[at]))
        at = at[nearer]
        held[at], distance[at], place[at] = other[nearer], met[nearer], 0


def _rows_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(at, ROWS_AT_ONCE)
        lists = part.column("v")
        flat = lists.flatten().to_numpy()
        yield part, flat.reshape(-1, width).astype(np.int64)


def _assigned(rows: DataFrame, points: np.ndarray, with_vectors: bool) -> DataFrame:
    """``id``, ``cluster`` and ``distance`` of each row, with ``v`` if wanted; ``cluster`` of ``rows`` is where the search begins."""
    k, width = points.shape
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids.of(points)
        for batch in batches:
            for part, vectors in _rows_of(batch, width):
                held, distance = nearest(vectors, centroids, part.column("cluster").to_numpy())
                columns = [part.column("id"), pa.array(held.astype(np.int32)), pa.array(distance)]
                names = ["id", "cluster", "distance"]
                if with_vectors:
                    columns, names = [*columns, part.column("v")], [*names, "v"]
                yield pa.RecordBatch.from_arrays(columns, names)

    more = ", v array<int>" if with_vectors else ""
    return rows.mapInArrow(run, f"id {kind}, cluster int, distance bigint{more}")


def _sums(rows: DataFrame, points: np.ndarray, search: bool) -> list:
    """Rows and component sums of each cluster: each task adds up its own rows, ``k * width`` numbers go on."""
    k, width = points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids.of(points) if search else None
        count, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for part, vectors in _rows_of(batch, width):
                held = part.column("cluster").to_numpy().astype(np.int64)
                if centroids is not None:
                    held, _ = nearest(vectors, centroids, held)
                count += np.bincount(held, minlength=k)
                by = np.argsort(held, kind="stable")
                first = np.flatnonzero(np.append(True, held[by][1:] != held[by][:-1]))
                sums[held[by][first]] += np.add.reduceat(vectors[by], first, axis=0)
        some = np.flatnonzero(count)
        at = np.repeat(some, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(np.tile(np.arange(width), len(some))), pa.array(sums[some].ravel()), pa.array(np.repeat(count[some], width))],
            ["cluster", "at", "total", "rows"],
        )

    parts = rows.select("cluster", "v").mapInArrow(run, "cluster bigint, at bigint, total bigint, rows bigint")
    # of all rows of one cluster and component; decimal sums cannot overflow
    summed = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows"))
    return summed.collect()


def _moved(points: np.ndarray, sums: list) -> np.ndarray:
    """Centroids at the floor of the mean of their rows; those without rows stay."""
    after = points.copy()
    for r in sums:
        after[r.cluster, r["at"]] = int(r.total) // r.rows
    return after


def cluster_vectors(
    vectors: DataFrame,
    clusters: int,
    rounds: int,
    draw: Column,
    width: int,
    factor: int,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Lloyd's rounds over the floors of ``factor`` times each component, all in whole numbers.

    The first centroids are the rows of the ``clusters`` smallest values of ``draw`` in that order (ties by id, then vector; null
    values cannot be drawn). Each round finds the nearest centroid of every row and moves every centroid that has
    rows to the floor of their mean; then rows are assigned once more. A round reads the packed rows once, searches beginning at the
    centroid of the first round.

    Returns ``vec_id``, ``cluster`` (from 0), ``distance`` (squared), ``cluster_inertia`` and ``inertia`` (its sums), and
    ``centroid_sha256``, one row per row that takes part: vectors that are null, hold null or non-finite components or
    have not ``width`` components do not. Repeated rows and null ids count like any other; with fewer rows than
    ``clusters`` there are fewer centroids; an empty table, or one without a value of ``draw``, gives no rows. Other columns are not read, whatever their
    names. Components beyond 2^27 after scaling, whose squared distances could pass 64 bits, raise an error.
    """
    if not 0 < clusters <= MAX_CENTROIDS:
        raise ValueError(f"between 1 and {MAX_CENTROIDS} clusters")
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    kept = vectors.where(usable(F.col(vector)) & (F.size(vector) == width)).select(
        F.col(vec_id).alias("id"), draw.alias("drawn"), F.transform(vector, lambda x: F.floor(x.cast("double") * factor)).alias("long")
    )
    first = kept.where("drawn IS NOT NULL").orderBy("drawn", "id", "long").limit(clusters).collect()
    schema = f"{vec_id} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    points = np.array([r.long for r in first], np.int64)
    small = F.forall("long", lambda x: (x >= -MAX_COMPONENT) & (x <= MAX_COMPONENT))
    too_large = F.raise_error(F.lit(f"a component passes {MAX_COMPONENT} after scaling, distances would not fit into 64 bits"))
    packed = kept.select(
        "id", F.lit(0).alias("cluster"), F.when(small, F.col("long").cast("array<int>")).otherwise(too_large.cast("array<int>")).alias("v")
    )
    # one table for all rounds: rows with the centroid they begin at
    rows = written(_assigned(packed, points, with_vectors=True), "orchard-rows")
    for step in range(rounds):
        points = _moved(points, _sums(rows, points, search=step > 0))
    found = written(_assigned(rows, points, with_vectors=False), "orchard-found")
    discard(rows)
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    text = [",".join(map(str, p)) for p in points.tolist()]
    totals = [(i, inertia.get(i, 0), sum(inertia.values()), text[i]) for i in range(len(points))]
    # one row per centroid
    known = F.broadcast(spark.createDataFrame(totals, "cluster int, cluster_inertia bigint, inertia bigint, centroid string"))
    return found.join(known, "cluster").select(
        F.col("id").alias(vec_id),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256"),
    )
