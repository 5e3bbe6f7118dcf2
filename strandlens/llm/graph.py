"""Connected components of very many nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlens.llm.common import discard, join_skewed, written


def connected(links: DataFrame, label: str) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``links`` (``a``, ``b``, both bigint).

    Each round takes the smallest root among neighbours, then the root of that root, so that paths halve. A hub
    is the neighbour of many nodes and the root of more in every round: both joins are told how many rows each key
    has and keep hubs out of the shuffle. Rounds are written to the shared folder; the last one stays.
    """
    both = links.union(links.select("b", "a")).where("a <> b").distinct()
    edges = written(both.toDF("node", "other"), f"{label}-edges")
    first = edges.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min("other").alias("least"))
    roots = written(first.select("node", "degree", F.least("node", "least").alias("root")), f"{label}-roots")
    while True:
        of_other = roots.select(F.col("node").alias("other"), "degree", F.col("root").alias("near"))
        near = join_skewed(edges, of_other, "other", "degree").groupBy("node").agg(F.min("near").alias("near"))
        stepped = written(
            roots.join(near, "node").select("node", "degree", "root", F.least("root", "near").alias("next")), f"{label}-steps"
        )
        asked = stepped.groupBy("next").agg(F.count(F.lit(1)).alias("rows"))
        ahead = asked.join(roots.select(F.col("node").alias("next"), F.col("root").alias("ahead")), "next")
        after = F.least("next", "ahead")
        moved = written(
            join_skewed(stepped, ahead, "next", "rows").select("node", "degree", after.alias("root"), (after < F.col("root")).alias("moved")),
            f"{label}-roots",
        )
        discard(roots, stepped)
        roots = moved
        if moved.where("moved").isEmpty():
            discard(edges)
            return roots.select("node", "root")
