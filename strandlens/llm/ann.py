"""Approximate nearest neighbours: NN-descent builds a graph, greedy search walks it.

Vectors are compared as 16-bit codes, each on its own scale, while the graph is built and walked: fine enough to tell members of
a tight cluster far from the origin apart. All that a walk holds at its end is scored in double precision. A node is a distinct vector, so that copies do not fill each other's lists.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlens.llm.common import BROADCAST_MAX_BYTES, broadcast_if_small, written
from strandlens.llm.vectors import matrix, usable

NEIGHBOURS = 32
"""Length of each node's list in the graph."""
BACKWARD = 32
"""How many nodes that list a node are walked from it, the nearest first."""
PARTITIONINGS = 6
LEAF = 1024
"""Leaves of a partitioning are split until none has more than twice as many nodes."""
SPLITS = 6
"""Levels by which a leaf is split in one pass over the table."""
SPLIT_SAMPLE = 4096
"""About how many nodes of a leaf its medians are taken from."""
SAMPLED = 14
"""How many of a node's nearest, and of those that list it, are compared in a round."""
CHANGED_LIMIT = 0.02
"""Rounds of NN-descent end once a round changes at most this share of all list entries."""
BEAM = 192
CODE_MAX = 32767
LEAST_LARGEST, MOST_LARGEST = 1e-150, 1e150
"""Where the largest component must lie. Any 32-bit floats do."""

NODES_PER_TASK = 4096
_LIST = "node bigint, ids array<bigint>, sims array<float>"


def _nodes(vectors: DataFrame, copies: int) -> DataFrame:
    """Distinct vectors: ``node`` is the smallest id, ``members`` the smallest ``copies`` ids."""
    same = Window.partitionBy("v").orderBy("id")
    kept = vectors.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= copies)
    return kept.groupBy("v").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("members"))


def _coded(nodes: DataFrame, width: int) -> DataFrame:
    """Adds ``code``: components as signed 16-bit numbers on the row's own scale, after that scale as a 32-bit float.

    Scales are relative to the largest component of the table, which keeps products finite.
    """
    largest = nodes.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    if not LEAST_LARGEST <= largest <= MOST_LARGEST:
        raise ValueError(f"the largest component is {largest}: products of such vectors leave the range of doubles; scale them")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), np.float64, width)
            own = np.abs(x).max(axis=1, keepdims=True)
            codes = np.rint(x / own * CODE_MAX).astype("<i2")
            scales = (own / largest).astype(np.float32)
            binary = pa.array([f.tobytes() + c.tobytes() for f, c in zip(scales, codes, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("v"), batch.column("members"), binary], ["node", "v", "members", "code"])

    return nodes.select("node", "v", "members").mapInArrow(run, "node bigint, v array<double>, members array<bigint>, code binary")


def _parts(joined: bytes | pa.Buffer, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of codes as floats, and their scales."""
    rows = np.frombuffer(joined, np.dtype([("scale", "<f4"), ("code", "<i2", (width,))]))
    return rows["code"].astype(np.float32) / np.float32(CODE_MAX), rows["scale"]


def _codes(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return _parts(b"".join(column.to_pylist()), width)


def _products(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All products of two sets of coded rows; the same for a pair in either order."""
    return (a[0] @ b[0].T) * np.multiply.outer(a[1], b[1])


def _lists(node: np.ndarray, ids: np.ndarray, sims: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(begins.astype(np.int32), pa.int32())
    columns = [pa.array(node), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(sims.astype(np.float32)))]
    return pa.RecordBatch.from_arrays(columns, ["node", "ids", "sims"])


def best_of(node: np.ndarray, ids: np.ndarray, sims: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The ``size`` nearest distinct ids of each node: nodes, ids, similarities and where each list begins."""
    order = np.lexsort((-sims, ids, node))
    node, ids, sims = node[order], ids[order], sims[order]
    fresh = np.ones(len(node), bool)
    fresh[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
    fresh &= node != ids
    node, ids, sims = node[fresh], ids[fresh], sims[fresh]
    order = np.lexsort((ids, -sims, node))
    node, ids, sims = node[order], ids[order], sims[order]
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    place = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    keep = place < size
    node, ids, sims = node[keep], ids[keep], sims[keep]
    owners, begins = np.unique(node, return_index=True)
    return owners, ids, sims, np.append(begins, len(node))


def _flat(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, sims = batch.column("ids"), batch.column("sims")
    return np.repeat(batch.column("node").to_numpy(), np.diff(ids.offsets.to_numpy())), ids.flatten().to_numpy(), sims.flatten().to_numpy()


def _by_task(rows: DataFrame, key: str, tasks: int, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Deals rows by ``key`` to tasks of a bounded number of nodes and hands each task its rows as one table."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(tasks, key).mapInArrow(whole, schema)


def _merged(lists: DataFrame, size: int, tasks: int) -> DataFrame:
    """Lists of the same node joined into one of the ``size`` nearest."""

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield _lists(*best_of(*_flat(rows.to_batches()[0]), size))

    return _by_task(lists, "node", tasks, run, _LIST)


def _projected(node: np.ndarray, codes: np.ndarray, scales: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Places of nodes along the normals of planes; equal codes are spread a little by id, so that any leaf can be halved."""
    with np.errstate(over="ignore"):
        mixed = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    spread = ((mixed >> np.uint64(11)).astype(np.float64) / 2.0**53 - 0.5)[:, None]
    along = (codes.astype(np.float64) * scales[:, None]) @ planes
    return along + (np.abs(along) * 1e-7 + 1e-30) * spread


def _halved(full: DataFrame, width: int, turn: int, depth: int) -> DataFrame:
    """Every leaf of ``full`` halved ``depth`` times at medians of a sample of it, along the directions of this turn."""
    planes = np.random.default_rng((11, turn)).standard_normal((PARTITIONINGS, width, depth))
    n_cuts = (1 << depth) - 1

    def medians(rows: pa.Table) -> pa.Table:
        along = _projected(rows.column("node").to_numpy(), *_codes(rows.column("code"), width), planes[rows.column("part")[0].as_py()])
        cuts, inside = np.zeros(n_cuts), np.zeros(len(along), np.int64)
        for level in range(depth):
            for i in range((1 << level) - 1, (2 << level) - 1):
                own = along[inside == i, level]
                cuts[i] = np.median(own) if len(own) else 0.0
            inside = 2 * inside + 1 + (along[:, level] > cuts[inside])
        return pa.table({"leaf": rows.column("leaf")[:1], "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64()))})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, node = batch.column("part").to_numpy(), batch.column("node").to_numpy()
            codes, scales = _codes(batch.column("code"), width)
            known = batch.column("cuts").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.zeros((len(node), n_cuts))
            cuts[known] = batch.column("cuts").drop_null().flatten().to_numpy().reshape(-1, n_cuts)
            inside = np.zeros(len(node), np.int64)
            for p in np.unique(part):
                own = np.flatnonzero(part == p)
                along = _projected(node[own], codes[own], scales[own], planes[p])
                for level in range(depth):
                    inside[own] = 2 * inside[own] + 1 + (along[:, level] > cuts[own, inside[own]])
            # a leaf of which nothing was drawn stays as it is until the next turn
            names = [f"{a}.{b}" if k else a for a, b, k in zip(batch.column("leaf").to_pylist(), inside.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), batch.column("part"), pa.array(names)], ["node", "code", "part", "leaf"])

    share = F.lit(float(SPLIT_SAMPLE)) / F.col("nodes")
    drawn = full.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 30)) < share * (1 << 30)).select("leaf", "part", "node", "code")
    cuts = written(drawn.groupBy("leaf").applyInArrow(medians, "leaf string, cuts array<double>"), "ann-cuts")
    if cuts.count() * 8 * (n_cuts + 8) <= BROADCAST_MAX_BYTES:
        cuts = F.broadcast(cuts)
    halved = full.join(cuts, "leaf", "left").select("node", "code", "part", "leaf", "cuts")
    return written(halved.mapInArrow(place, "node bigint, code binary, part int, leaf string"), "ann-leaves")


def _leaves(coded: DataFrame, n: int, width: int) -> DataFrame:
    """``node``, ``code`` and ``leaf`` for each partitioning; no leaf has more than ``2 LEAF`` nodes.

    Every leaf with more is halved at the medians of its own nodes along fresh random directions, ``SPLITS``
    times in a turn. The directions of a turn are shared, the medians are a leaf's own, so dense regions
    are split as far as any other.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTITIONINGS - 1)))
    full = coded.select("node", "code").withColumn("part", every).withColumn("leaf", F.col("part").cast("string"))
    full, most, done = full.withColumn("nodes", F.lit(n).cast("bigint")), n, []
    for turn in count():
        done.append(full.where(F.col("nodes") <= 2 * LEAF).select("leaf", "node", "code"))
        if most <= 2 * LEAF:
            return reduce(DataFrame.union, done)
        depth = min(SPLITS, math.ceil(math.log2(most / (2 * LEAF))))
        halved = _halved(full.where(F.col("nodes") > 2 * LEAF), width, turn, depth)
        sizes = written(halved.groupBy("leaf").agg(F.count(F.lit(1)).alias("nodes")), "ann-leaf-sizes")
        most = sizes.agg(F.max("nodes")).first()[0] or 0
        full = halved.join(broadcast_if_small(sizes), "leaf")


def _first_lists(coded: DataFrame, n: int, width: int, size: int, tasks: int) -> DataFrame:
    """Lists from a few random partitionings: the nearest among the nodes of the same leaf."""
    placed = _leaves(coded, n, width)
    def nearest(rows: pa.Table) -> pa.Table:
        node, (codes, scales) = rows.column("node").to_numpy(), _codes(rows.column("code"), width)
        top = min(size, len(node) - 1)
        if top < 1:
            return pa.Table.from_batches([_lists(node[:0], node[:0], np.zeros(0), np.zeros(1))])
        ids, sims = np.empty((len(node), top), np.int64), np.empty((len(node), top), np.float32)
        for at in range(0, len(node), 256):
            s = _products((codes[at : at + 256], scales[at : at + 256]), (codes, scales))
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
            found = np.argpartition(-s, top - 1, axis=1)[:, :top]
            ids[at : at + 256], sims[at : at + 256] = node[found], np.take_along_axis(s, found, 1)
        return pa.Table.from_batches([_lists(node, ids.ravel(), sims.ravel(), np.arange(len(node) + 1) * top)])

    return _merged(placed.groupBy("leaf").applyInArrow(nearest, _LIST), size, tasks)


def _edges(graph: DataFrame, forward: int, backward: int) -> DataFrame:
    """``owner`` with its nearest ``forward`` and the nearest ``backward`` of those that list it."""
    pairs = graph.select("node", F.explode(F.arrays_zip(F.slice("ids", 1, forward).alias("id"), F.slice("sims", 1, forward).alias("sim"))).alias("e"))
    there = pairs.select(F.col("node").alias("owner"), F.col("e.id").alias("member"))
    back = pairs.select(F.col("e.id").alias("owner"), F.col("node").alias("member"), F.col("e.sim").alias("sim"))
    nearest = Window.partitionBy("owner").orderBy(F.col("sim").desc(), "member")
    back = back.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= backward).select("owner", "member")
    return there.union(back).distinct()


def _descended(graph: DataFrame, coded: DataFrame, width: int, size: int, tasks: int) -> DataFrame:
    """One round of NN-descent: neighbours of a node are compared with each other and improve their lists."""
    worst = graph.select("node", F.when(F.size("sims") >= size, F.array_min("sims")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
    members = coded.select("node", "code").join(worst, "node", "left").withColumnRenamed("node", "member")
    met = _edges(graph, SAMPLED, SAMPLED).join(members, "member")

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        owner, member = rows.column("owner").to_numpy(), rows.column("member").to_numpy()
        worst_of = rows.column("worst").fill_null(float("-inf")).to_numpy()
        order = np.argsort(owner, kind="stable")
        begins = np.flatnonzero(np.append(True, np.diff(owner[order]) != 0))
        codes, scales = _codes(rows.column("code"), width)
        us, ws, ss = [], [], []
        for at, end in zip(begins, np.append(begins[1:], len(order)), strict=True):
            i = order[at:end]
            s = _products((codes[i], scales[i]), (codes[i], scales[i]))
            a, b = np.nonzero(s > worst_of[i][:, None])
            apart = a != b
            us.append(member[i][a[apart]])
            ws.append(member[i][b[apart]])
            ss.append(s[a[apart], b[apart]])
        yield _lists(*best_of(np.concatenate(us), np.concatenate(ws), np.concatenate(ss), size))

    found = _by_task(met, "owner", tasks, compare, _LIST)
    return _merged(graph.union(found), size, tasks)


def _changed(before: DataFrame, after: DataFrame) -> float:
    """The share of list entries that ``before`` did not have."""
    old = before.select("node", F.col("ids").alias("old"))
    fresh = F.size(F.array_except("ids", F.coalesce("old", F.array().cast("array<bigint>"))))
    changed, entries = after.join(old, "node", "left").agg(F.sum(fresh), F.sum(F.size("ids"))).first()
    return (changed or 0) / (entries or 1)


def build_graph(coded: DataFrame, n: int, width: int, size: int = NEIGHBOURS, changed_limit: float = CHANGED_LIMIT) -> DataFrame:
    """The neighbour graph over all nodes: ``node``, ``ids`` and ``sims`` (products of codes), nearest first.

    Rounds are repeated until one changes at most ``changed_limit`` of all entries. Lists only get better,
    so the rounds end.
    """
    tasks = max(1, -(-n // NODES_PER_TASK))
    graph = written(_first_lists(coded, n, width, size, tasks), "ann-graph")
    while True:
        before, graph = graph, written(_descended(graph, coded, width, size, tasks), "ann-graph")
        if _changed(before, graph) <= changed_limit:
            return graph


def _adjacency(graph: DataFrame, coded: DataFrame, size: int, tasks: int) -> DataFrame:
    """All that is walked from a node, packed: ids and codes."""
    met = _edges(graph, size, BACKWARD).join(coded.select(F.col("node").alias("member"), "code"), "member")

    def pack(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pa.array(np.argsort(rows.column("owner").to_numpy(), kind="stable"))).combine_chunks()
        owner, member, codes = rows.column("owner").to_numpy(), rows.column("member").to_numpy(), rows.column("code").to_pylist()
        begins = np.flatnonzero(np.append(True, np.diff(owner) != 0))
        ends = np.append(begins[1:], len(owner))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(owner[begins]),
                pa.array([member[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
                pa.array([b"".join(codes[a:b]) for a, b in zip(begins, ends, strict=True)], pa.binary()),
            ],
            ["node", "near_ids", "near_codes"],
        )

    return _by_task(met, "owner", tasks, pack, "node bigint, near_ids binary, near_codes binary")


def _walked(beams: DataFrame, adjacency: DataFrame, width: int, beam: int, tasks: int) -> DataFrame:
    """Walks from all unwalked entries of each beam and keeps the nearest ``beam`` of old and new."""
    entries = F.arrays_zip("ids", "walked")
    open_ids = F.transform(F.filter(entries, lambda e: ~e["walked"]), lambda e: e["ids"])
    floor = F.when(F.size("sims") >= beam, F.array_min("sims")).otherwise(F.lit(float("-inf"))).cast("float")
    asked = beams.select(F.col("node").alias("query"), "code", floor.alias("floor"), F.explode(open_ids).alias("node"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, (codes, scales) = batch.column("query").to_numpy(), _codes(batch.column("code"), width)
            floors = batch.column("floor").to_numpy()
            ids, sims, sizes = [], [], []
            for i, (a, b) in enumerate(zip(batch.column("near_ids"), batch.column("near_codes"), strict=True)):
                s = _products(_parts(b.as_buffer(), width), (codes[i : i + 1], scales[i : i + 1]))[:, 0]
                good = s > floors[i]
                ids.append(np.frombuffer(a.as_buffer(), np.int64)[good])
                sims.append(s[good])
                sizes.append(int(good.sum()))
            if ids:
                yield _lists(queries, np.concatenate(ids), np.concatenate(sims), np.concatenate(([0], np.cumsum(sizes))))

    seen = asked.join(adjacency, "node").select("query", "code", "floor", "near_ids", "near_codes").mapInArrow(look, _LIST)
    everything = seen.select("node", "ids", "sims", F.lit(None).cast("array<boolean>").alias("walked"), F.lit(None).cast("binary").alias("code")).union(
        beams.select("node", "ids", "sims", F.transform("ids", lambda _: F.lit(True)).alias("walked"), "code")
    )

    def keep(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = rows.to_batches()[0]
        node, ids, sims = _flat(batch)
        old = np.array([c is not None for c in batch.column("code").to_pylist()])
        before = np.repeat(old, np.diff(batch.column("ids").offsets.to_numpy()))
        code_of = dict(zip(batch.column("node").to_numpy()[old].tolist(), [c for c in batch.column("code").to_pylist() if c is not None], strict=True))
        owners, ids_kept, sims_kept, begins = best_of(node, ids, sims, beam)
        # entries of the beam before have been walked by now
        pair = np.dtype([("node", np.int64), ("id", np.int64)])
        known = np.unique(np.rec.fromarrays([node[before], ids[before]], dtype=pair))
        now = np.rec.fromarrays([np.repeat(owners, np.diff(begins)), ids_kept], dtype=pair)
        walked = known[np.minimum(np.searchsorted(known, now), len(known) - 1)] == now if len(known) else np.zeros(len(now), bool)
        out = _lists(owners, ids_kept, sims_kept, begins)
        marks = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(walked))
        yield pa.RecordBatch.from_arrays(
            [*out.columns, marks, pa.array([code_of[o] for o in owners.tolist()], pa.binary())], ["node", "ids", "sims", "walked", "code"]
        )

    return _by_task(everything, "node", tasks, keep, _LIST + ", walked array<boolean>, code binary")


def search_neighbours(
    embeddings: DataFrame, k: int, asked: Column, vec_id: str = "vec_id", vector: str = "embedding", beam: int = BEAM
) -> DataFrame:
    """The ``k`` rows of largest inner product found for every row that ``asked`` chooses, itself left out.

    All rows are indexed. Walks begin at the query's own list in the graph and follow
    all entries of the beam not followed before, until there are none. Copies of a vector are one node; the ``k + 1`` smallest
    ids of a node are enough for any result. Found nodes are scored in double precision from the
    original vectors, ties go to the smaller id.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``. Vectors that are null, empty, zero or hold null
    or non-finite components take no part, nor do null ids; shorter vectors count as filled with
    zeros; fewer candidates than ``k`` give fewer results; an empty table gives none. A largest component beyond 1e150 or below
    1e-150, as only 64-bit vectors can have, is an error. Other columns are
    not read, whatever their names.
    """
    v = F.col(vector)
    whole = embeddings.where(usable(v) & F.col(vec_id).isNotNull() & F.exists(v, lambda x: x != 0))
    exact = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))
    rows = whole.select(F.col(vec_id).cast("bigint").alias("id"), exact.alias("v"))
    nodes = written(_nodes(rows, k + 1), "ann-nodes")
    n, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    coded = written(_coded(nodes, width), "ann-coded")
    size = NEIGHBOURS
    graph = build_graph(coded, n, width, size)
    tasks = max(1, -(-n // NODES_PER_TASK))
    adjacency = written(_adjacency(graph, coded, size, tasks), "ann-adjacency")

    queries = whole.where(asked).select(F.col(vec_id).cast("bigint").alias("query_id"), exact.alias("v"))
    # the node of a query by its vector; equal queries walk once
    of_query = written(queries.join(nodes.select("node", "v"), "v").select("query_id", "node"), "ann-queries")
    begun = of_query.select("node").distinct().join(coded.select("node", "code"), "node").join(graph, "node", "left")
    none = F.array().cast("array<bigint>")
    beams = written(
        begun.select(
            "node",
            F.coalesce("ids", none).alias("ids"),
            F.coalesce("sims", none.cast("array<float>")).alias("sims"),
            F.transform(F.coalesce("ids", none), lambda _: F.lit(False)).alias("walked"),
            "code",
        ),
        "ann-beams",
    )
    while beams.where(F.exists("walked", lambda w: ~w)).limit(1).count():
        beams = written(_walked(beams, adjacency, width, beam, tasks), "ann-beams")

    # the whole beam is scored exactly; the node itself counts for its other copies
    near = beams.select("node", F.explode(F.concat(F.array("node"), F.col("ids"))).alias("other"))
    product = F.aggregate(F.zip_with("q", "v", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    scored = (
        near.join(nodes.select(F.col("node").alias("other"), "v", "members"), "other")
        .join(nodes.select("node", F.col("v").alias("q")), "node")
        .select("node", product.alias("score"), F.explode("members").alias("vec_id"))
    )
    by_score = Window.partitionBy("node").orderBy(F.col("score").desc(), "vec_id")
    best = scored.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1).drop("place")
    of_own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = of_query.join(best, "node").where("vec_id <> query_id").withColumn("rank", F.row_number().over(of_own))
    return found.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
