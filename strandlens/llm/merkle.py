"""Merkle manifest of a dataset: nested-struct rollup of rank digits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlens.llm.common import broadcast_if_small, discard, written

FAN_BITS = 4
FAN = 1 << FAN_BITS
BLOCK_LEVELS = 2
"""Levels of one block: 256 nodes, some 40 kB with their nested children."""

MAX_LEVELS = 15
HEX = 64
TIES = 1024
STEP = "struct<left:string,right:string>"


def leaf_hash(columns: list[Column]) -> Column:
    """Hash of the values one after another, each with its number of bytes in front; null is a dash."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` (written) with ``rank`` (from 0, by ``order``) and ``nodes`` within each ``key``.

    Rows are dealt by ranges of key and order, so that a key with a third of all rows spreads over tasks; a rank is the place
    in its range plus the rows of the key in earlier ranges. Rows that are alike in all of that are dealt
    apart by a tie number.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("tie", F.pmod(F.monotonically_increasing_id(), F.lit(TIES)))
    by = ["key", *order, "tie"]
    dealt = tied.repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    placed = written(dealt.drop("tie").withColumn("range", F.shiftright("place", 33)), f"{label}-placed")
    runs = placed.groupBy("key", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    of_key = Window.partitionBy("key")
    earlier = of_key.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range and key that meet
    runs = runs.withColumns({"before": F.coalesce(F.sum("rows").over(earlier), F.lit(0)), "nodes": F.sum("rows").over(of_key)})
    rank = F.col("before") + F.col("place") - F.col("first")
    found = placed.join(broadcast_if_small(written(runs.drop("rows"), f"{label}-runs")), ["key", "range"])
    return found.withColumn("rank", rank).drop("range", "place", "first", "before")


def _height(nodes: Column) -> Column:
    """Levels until one node is left."""
    return reduce(lambda a, b: a + b, [(nodes > F.lit(FAN**i)).cast("int") for i in range(MAX_LEVELS)])


def _grouped(rows: DataFrame, by: list[str], digit: str, fields: list[str], level: int) -> DataFrame:
    """One digit column grouped away: rows of equal ``by`` become ``children``, in order, and their hash.

    Above its tree's height a run has one node, which goes on as it is.
    """
    nested = rows.groupBy(*by).agg(
        F.first("height").alias("height"), F.sort_array(F.collect_list(F.struct(digit, "hash", *fields))).alias("children")
    )
    joined = F.sha2(F.array_join(F.transform("children", lambda c: c["hash"]), ""), 256)
    return nested.withColumn("hash", F.when(F.col("height") > level, joined).otherwise(F.col("children")[0]["hash"]))


def _tier(rows: DataFrame, base: int, fields: list[str], label: str) -> DataFrame:
    """Blocks of nodes: ``key``, ``block``, ``height``, ``hash`` and ``children`` nested by digit.

    ``rows`` has ``key``, ``rank``, ``height``, ``hash`` and ``fields``; ``base`` levels lie below. All digits of a block are grouped
    away in the task that holds the block, after one shuffle.
    """
    digits = [f"digit{i}" for i in range(BLOCK_LEVELS)]
    columns = {d: F.shiftright("rank", FAN_BITS * i).bitwiseAND(F.lit(FAN - 1)).cast("tinyint") for i, d in enumerate(digits)}
    columns["block"] = F.shiftright("rank", FAN_BITS * BLOCK_LEVELS)
    nodes = rows.withColumns(columns).select("key", "block", "height", *digits, "hash", *fields).repartition("key", "block")
    for i, digit in enumerate(digits):
        nodes = _grouped(nodes, ["key", "block", *digits[i + 1 :]], digit, fields if i == 0 else ["children"], base + i)
    return written(nodes, label)


def _tree(nodes: DataFrame, fields: list[str], label: str) -> list[DataFrame]:
    """Tiers of blocks up to one block a key. ``nodes`` has ``key``, ``rank``, ``nodes``, ``hash`` and ``fields``."""
    rows = nodes.withColumn("height", _height(F.col("nodes")))
    tiers = [_tier(rows, 0, fields, f"{label}-blocks")]
    highest = tiers[0].agg(F.max("height")).first()[0] or 0
    while BLOCK_LEVELS * len(tiers) < highest:
        below = tiers[-1].select("key", F.col("block").alias("rank"), "height", "hash")
        tiers.append(_tier(below, BLOCK_LEVELS * len(tiers), [], f"{label}-blocks"))
    return tiers


def _unfolded(blocks: DataFrame, above: DataFrame, base: int, known: list[str]) -> DataFrame:
    """Children of the lowest digit with ``steps``: siblings left and right of the way up, from the lowest level.

    ``above`` has the steps (and ``known`` columns) of each block. Both tables are grouped by block, not joined: a block has
    one row of each.
    """
    parts = blocks.select("key", "block", "height", "children").unionByName(above.select("key", "block", "steps", *known), True)
    rows = parts.groupBy("key", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("height", "children", "steps", *known)])
    for i in reversed(range(BLOCK_LEVELS)):
        rows = rows.withColumn("run", F.array_join(F.transform("children", lambda c: c["hash"]), ""))
        rows = rows.select("key", "block", "height", "steps", *known, "run", F.posexplode("children").alias("at", "child"))
        left = F.substring("run", F.lit(1), F.col("at") * HEX)
        right = F.substring("run", (F.col("at") + 1) * HEX + 1, F.length("run"))
        step = F.when(F.col("height") > base + i, F.array(F.struct(left.alias("left"), right.alias("right"))))
        steps = F.concat(F.coalesce(step, F.array().cast(f"array<{STEP}>")), F.col("steps"))
        digit = f"digit{i}"
        place = F.col("child")[digit].cast("bigint")
        if i:
            rows = rows.select("key", "block", "height", steps.alias("steps"), *known, place.alias(digit), F.col("child.children").alias("children"))
            upper = F.shiftleft(F.col("block"), FAN_BITS) + F.col(digit)
            rows = rows.withColumn("block", upper).drop(digit)
        else:
            rank = F.shiftleft(F.col("block"), FAN_BITS) + place
            rows = rows.select("key", rank.alias("rank"), steps.alias("steps"), *known, "child")
    return rows


def _proofs(tiers: list[DataFrame], above: DataFrame, known: list[str]) -> DataFrame:
    """``child`` (hash and fields), ``steps`` and ``known`` of every node of the lowest tier; ``above`` has those of each key."""
    rows = above.withColumn("block", F.lit(0).cast("bigint"))
    for i in reversed(range(len(tiers))):
        rows = _unfolded(tiers[i], rows, BLOCK_LEVELS * i, known)
        if i:
            rows = rows.withColumnRenamed("rank", "block").drop("child")
    return rows


def manifest(docs: DataFrame, doc_id: str, source: str, columns: list[str], changed: dict[str, Column], tampered: Column) -> DataFrame:
    """Leaf, subroot of its source, root, proof and check of every row.

    ``columns`` are hashed into a leaf in that order. Where ``tampered`` holds, the check begins with the leaf that ``changed``
    (new values by column) gives, else with the original one; siblings are the originals. Within a source (null is one
    of its own) leaves ascend by id, null first, equal ids by leaf; sources ascend by bytes, null first.

    Returns ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``, one row per row;
    repeated rows are leaves of their own. An empty table gives no rows; null and empty texts differ. Only the
    named columns are read. A text of any length is hashed whole. A null in ``tampered`` counts as false.
    """
    original = [F.col(c) for c in columns]
    new = [changed.get(c, F.col(c)) for c in columns]
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    leaves = docs.select(
        key.alias("key"), F.col(doc_id).alias("id"), leaf_hash(original).alias("hash"), F.when(tampered, leaf_hash(new)).alias("changed")
    )
    leaves = written(leaves, "merkle-leaves")
    tiers = _tree(_ranked(leaves, ["id", "hash"], "merkle"), ["id", "changed"], "merkle")
    discard(leaves)
    subroots = written(tiers[-1].select(F.col("key").alias("source"), "hash"), "merkle-subroots")
    of_all = subroots.withColumn("key", F.lit(""))
    trunk = _tree(_ranked(of_all, ["source"], "merkle-trunk"), ["source"], "merkle-trunk")
    top = trunk[-1].select("key", F.array().cast(f"array<{STEP}>").alias("steps"), F.col("hash").alias("root"))
    above = _proofs(trunk, top, ["root"]).select(
        F.col("child.source").alias("key"), "steps", "root", F.col("child.hash").alias("subroot")
    )
    rows = _proofs(tiers, above, ["root", "subroot"])
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    begin = F.coalesce(F.col("child.changed"), F.col("child.hash"))
    folded = F.aggregate("steps", begin, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    return rows.select(
        F.col("child.id").alias("doc_id"),
        F.col("child.hash").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
