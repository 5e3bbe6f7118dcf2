"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection.

Only sets that can have a partner get that far. All steps are exact, none looks at a sample of the
documents:

1. Documents with the same shingle set form a class (``key``); classes stand for their documents.
2. A class can only link if at least 80 % of its shingles occur in other classes. Shingles of one class
   alone are counted among those with a small hash (all of them for small sets); classes with more than
   20 % go. What is left are copies, and texts made of common passages.
3. Tiles are sets of similar size that share one of their first shingles (in hash order). Each set is
   held against a few pivots of its tile: bit counts of the signatures bound the overlap, then the
   arrays decide. Links give components.
4. A link that is still missing joins two components, and again needs 80 % of shingles that occur in
   other components. The sets of which that holds are held against all sets of other components in the
   tiles of their whole prefix, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlens.llm.common import BROADCAST_MAX_BYTES, HOT_KEYS, batches_of, broadcast_if_small, written
from strandlens.llm.graph import connected
from strandlens.llm.words import chained, hashed_words, mixed, slices

WORDS = 5
PERCENT = 80
SIGNATURE_WORDS = 16
WIDE_WORDS = 64
PIVOTS = 2
FIRST_SHINGLES = 3
BLOCK = 512
PAIRS_PER_BATCH = 256
ROWS_PER_BATCH = 2000
"""Rows that go to Python at once: whole texts, or signatures with prefixes as long as a fifth of a set."""
CARRIED = 100_000
HOT_SAMPLE = 16
"""One of so many sets is looked at for very common shingles; which they are changes the work, not the links."""

# Sets of up to this size show all shingles; the judged ones are so small that their partners do, too.
SHOWN_WHOLE = 160
JUDGED_WHOLE = 128
SHORT_BITS = 48
"""Where shingles are only counted, this much of a hash goes through the shuffle: two that agree count as shared, which loses no link."""
_SAMPLE = int(0.3 * 2**SHORT_BITS)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    found = hashed_words(texts)
    count = np.diff(found.begins)
    owner = found.texts
    grams = chained(found.hashes, tuple(range(words)))
    inside = owner[: len(grams)] == owner[len(owner) - len(grams) :]
    hashes, owners = grams[inside], owner[: len(grams)][inside]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        own = [chained(found.hashes[found.begins[i] : found.begins[i + 1]], tuple(range(count[i])))[0] for i in short]
        hashes, owners = np.append(hashes, np.array(own, np.uint64)), np.append(owners, short)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[fresh], owners[fresh]
    return hashes, np.searchsorted(owners, np.arange(len(count) + 1))


def set_keys(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each set, from the sum of its elements' hashes and its size."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes + np.uint64(0x51ED27)), out=sums[1:])
    return mixed(sums[begins[1:]] - sums[begins[:-1]] + np.diff(begins).astype(np.uint64))


def signatures(hashes: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` 64-bit words for each set, one bit per shingle."""
    out = np.zeros((len(begins) - 1) * size, np.uint64)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    bit = hashes & np.uint64(64 * size - 1)
    np.bitwise_or.at(out, owner * size + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def _lists(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(begins, pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))


def _sized(docs: DataFrame, words: int) -> DataFrame:
    """For each document its class and its number of shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, begins = shingle_sets(part.column("text"), words)
                keys, sizes = set_keys(hashes, begins).view(np.int64), np.diff(begins)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array(keys, mask=sizes == 0),
                        pa.array(sizes.astype(np.int64)),
                    ],
                    ["doc_id", "text_hash", "key", "n_shingles"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, text_hash bigint, key bigint, n_shingles bigint")


def _shown(docs: DataFrame, words: int) -> DataFrame:
    """``key`` and the shortened hashes ``shown`` of each class, which a task gives once for all copies that it meets.

    Texts are hashed a second time for this, so that these hashes, most of what is shuffled, are not also written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                hashes, begins = shingle_sets(part.column("text"), words)
                keys, sizes = set_keys(hashes, begins).view(np.int64), np.diff(begins)
                first = np.zeros(len(keys), bool)
                for i, k in enumerate(keys.tolist()):
                    if sizes[i] and k not in met:
                        met.add(k)
                        first[i] = True
                short = hashes >> np.uint64(64 - SHORT_BITS)
                show = np.repeat(first, sizes) & ((short < _SAMPLE) | np.repeat(sizes <= SHOWN_WHOLE, sizes))
                at = np.concatenate(([0], np.cumsum(show)))[begins]
                rows = [pa.array(keys), _lists(short[show].view(np.int64), at)]
                yield pa.RecordBatch.from_arrays(rows, ["key", "shown"]).filter(pa.array(first))

    return docs.select("text").mapInArrow(run, "key bigint, shown array<bigint>")


def _spare(n: Column) -> Column:
    """How many shingles of a set may be missing from a partner: all but the least overlap."""
    return F.floor(n * (100 - PERCENT) / 100)


def _classes_with_partners(sized: DataFrame, shown: DataFrame) -> DataFrame:
    """Classes of which enough shingles occur in others: ``key``, ``doc_id`` (the smallest) and ``n``."""
    classes = sized.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    alone = (
        shown.select("key", F.explode("shown").alias("h"))
        .groupBy("h")
        .agg(F.min("key").alias("key"), F.max("key").alias("last"))
        .where("key = last")
        .groupBy("key")
        .agg(F.count_if(F.col("h") < _SAMPLE).alias("alone_sampled"), F.count(F.lit(1)).alias("alone"))
    )
    judged = F.coalesce(F.when(F.col("n") <= JUDGED_WHOLE, F.col("alone")).otherwise(F.col("alone_sampled")), F.lit(0))
    return classes.join(alone, "key", "left").where(judged <= _spare(F.col("n"))).drop("alone", "alone_sampled")


def _sets_of(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """Whole shingle arrays and signatures of the chosen classes, from one document each."""
    ids = chosen.select(F.col("doc_id").alias("of_id")).distinct()
    texts = docs.join(broadcast_if_small(ids), F.col("doc_id").eqNullSafe(F.col("of_id"))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, begins = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(set_keys(hashes, begins).view(np.int64)),
                        pa.array(np.diff(begins).astype(np.int64)),
                        _lists(hashes.view(np.int64), begins),
                        _lists(signatures(hashes, begins, SIGNATURE_WORDS), np.arange(len(begins)) * SIGNATURE_WORDS),
                        pa.array([w.tobytes() for w in signatures(hashes, begins, WIDE_WORDS).reshape(-1, WIDE_WORDS)], pa.binary()),
                    ],
                    ["key", "n", "shingles", "signature", "wide"],
                )

    schema = "key bigint, n bigint, shingles array<bigint>, signature array<bigint>, wide binary"
    sets = texts.mapInArrow(run, schema).where("n > 0").join(broadcast_if_small(chosen.select("key")), "key", "left_semi")
    found = written(sets, "ngram-sets")
    # ids that occur once, as ids do, give each class once: then no array is moved
    return found if found.count() == chosen.count() else written(found.dropDuplicates(["key"]), "ngram-sets")


def _in_bands(rows: DataFrame) -> DataFrame:
    """Each row in its own size band and the next: sizes of linked sets differ by a quarter at most."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / PERCENT)) + 1e-9)
    return rows.withColumn("own", band).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))


def _may_link(n: Column, signature: Column, other_n: Column, other_signature: Column) -> Column:
    """The bound: every bit that only one set has stands for a shingle that only it has."""

    def only(a: Column, b: Column) -> Column:
        bits = F.lit(0)
        for i in range(SIGNATURE_WORDS):
            bits = bits + F.bit_count(a[i].bitwiseAND(F.bitwise_not(b[i])))
        return bits

    most = F.least(n - only(signature, other_signature), other_n - only(other_signature, signature))
    return (100 + PERCENT) * most >= PERCENT * (n + other_n)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs that signatures of 4096 bits leave, written: few unlinked ones need their arrays."""
    wide = sets.select("key", "n", "wide")
    other = wide.select(F.col("key").alias("other"), F.col("n").alias("other_n"), F.col("wide").alias("other_wide"))
    both = pairs.join(broadcast_if_small(wide), "key").join(broadcast_if_small(other), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDE_WORDS) for c in ("wide", "other_wide")
            )
            n, m = batch.column("n").to_numpy(), batch.column("other_n").to_numpy()
            mine = n - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
            theirs = m - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
            good = (100 + PERCENT) * np.minimum(mine, theirs) >= PERCENT * (n + m)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("other")], ["key", "other"]).filter(pa.array(good))

    chosen = both.select("key", "other", "n", "other_n", "wide", "other_wide")
    return written(chosen.mapInArrow(run, "key bigint, other bigint"), "ngram-bounded")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (``key``, ``other``) whose exact overlap is enough, written.

    Rows hold two whole arrays, so Arrow batches are kept to ``PAIRS_PER_BATCH`` rows.
    """
    pairs = _bounded(pairs, sets)
    left = sets.select("key", "shingles").join(broadcast_if_small(pairs), "key")
    right = sets.join(broadcast_if_small(pairs.select(F.col("other").alias("key")).distinct()), "key", "left_semi")
    right = right.select(F.col("key").alias("other"), F.col("shingles").alias("others"))
    # arrays of 8 bytes an element: counted before any broadcast
    bytes_right = right.agg(F.sum(F.size("others") * 8)).first()[0] or 0
    both = left.join(F.broadcast(right) if bytes_right <= BROADCAST_MAX_BYTES else right, "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("shingles"), batch.column("others")
            at_a, at_b = a.offsets.to_numpy(), b.offsets.to_numpy()
            flat_a, flat_b = (x.values.to_numpy().view(np.uint64) for x in (a, b))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = flat_a[at_a[i] : at_a[i + 1]], flat_b[at_b[i] : at_b[i + 1]]
                common = overlap(x, y)
                good[i] = 100 * common >= PERCENT * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("other")], ["key", "other"]).filter(pa.array(good))

    with batches_of(pairs.sparkSession, PAIRS_PER_BATCH):
        found = both.select("key", "other", "shingles", "others").mapInArrow(run, "key bigint, other bigint")
        return written(found, "ngram-links")


def _components(links: DataFrame) -> DataFrame:
    """``key`` and ``root``, the smallest key reachable, for every key with a link."""
    return connected(links.select(F.col("key").alias("a"), F.col("other").alias("b")), "ngram").toDF("key", "root")


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` after further links, which join whole components: only these are gone through again."""
    known = broadcast_if_small(roots)
    ends = more.join(known, "key", "left").withColumn("a", F.coalesce("root", "key")).drop("root", "key")
    ends = ends.withColumnRenamed("other", "key").join(known, "key", "left").withColumn("b", F.coalesce("root", "key"))
    over = connected(written(ends.select("a", "b").where("a <> b").distinct(), "ngram-merges"), "ngram-merged").toDF("root", "top")
    # a component of one set has no row of its own yet
    every = roots.union(over.select(F.col("root").alias("key"), "root").join(known.select("key"), "key", "left_anti"))
    joined = every.join(broadcast_if_small(over), "root", "left")
    return written(joined.select("key", F.coalesce("top", "root").alias("root")), "ngram-merged")


def _pivot_pairs(sets: DataFrame) -> DataFrame:
    """Each set with a few pivots of its tiles, where size and signature leave a chance."""
    tiles = _in_bands(sets.select("key", "n", "signature", F.explode(F.slice("shingles", 1, FIRST_SHINGLES)).alias("h")))
    pivots = tiles.groupBy("h", "band").agg(
        F.count(F.lit(1)).alias("sets"),
        F.array(
            *(
                F.min(F.struct(F.xxhash64(F.lit(i), "key").alias("draw"), "key", "n", "signature")) if i else
                F.min(F.struct(F.col("key").alias("draw"), "key", "n", "signature"))
                for i in range(PIVOTS)
            )
        ).alias("pivots"),
    )
    met = tiles.join(pivots.where("sets > 1"), ["h", "band"]).select("key", "n", "signature", F.explode("pivots").alias("p"))
    fits = (F.col("key") != F.col("p.key")) & _may_link(F.col("n"), F.col("signature"), F.col("p.n"), F.col("p.signature"))
    return written(met.where(fits).select("key", F.col("p.key").alias("other")).distinct(), "ngram-pairs")


def _ranked(h: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Shingles as numbers that put the rarer first: the power of two of their sets, then 58 bits of the hash.

    Two hashes that agree in these bits make a candidate more, none less.
    """
    power = np.frexp(sets.astype(np.float64))[1].astype(np.uint64)
    return ((power << np.uint64(58)) | (h.view(np.uint64) >> np.uint64(6))).view(np.int64)


def _foreign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (``h``, ``key``, ``root``, sorted by ``h``) the shingles of more than one component, ranked.

    The last shingle of a batch is carried on. One of more than ``CARRIED`` rows counts as that many, of several components:
    every one of its rows says so.
    """
    carried = [np.zeros(0, np.int64)] * 3
    going = None

    def out(h: np.ndarray, key: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(_ranked(h, sets))], ["key", "ranked"])

    def closed(h: np.ndarray, key: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        sizes = np.diff(np.append(begins, len(h)))
        apart = np.minimum.reduceat(root, begins) != np.maximum.reduceat(root, begins)
        keep = np.repeat(apart, sizes)
        return out(h[keep], key[keep], np.repeat(np.minimum(sizes, CARRIED), sizes)[keep])

    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("h", "key", "root")]
        if going is not None:
            same = rows[0] == going
            if same.any():
                yield out(rows[0][same], rows[1][same], np.full(same.sum(), CARRIED))
            if same.all():
                continue
            rows, going = [r[~same] for r in rows], None
        h, key, root = (np.concatenate([c, r]) for c, r in zip(carried, rows, strict=True))
        if not len(h):
            continue
        last = int(np.searchsorted(h != h[-1], False)) if h[0] == h[-1] else len(h) - int(np.argmax(h[::-1] != h[-1]))
        if last:
            yield closed(h[:last], key[:last], root[:last])
        carried = [h[last:], key[last:], root[last:]]
        if len(carried[0]) > CARRIED:
            going = h[-1]
            yield out(carried[0], carried[1], np.full(len(carried[0]), CARRIED))
            carried = [c[:0] for c in carried]
    if len(carried[0]):
        yield closed(*carried)


def _with_common(sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """``sets`` with ``common`` in place of ``shingles``: those that are among ``hot`` (sorted), ranked last, in order."""
    if not len(hot):
        return sets.drop("shingles").withColumn("common", F.array().cast("array<bigint>"))
    kept = [f for f in sets.schema.fields if f.name != "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = batch.column("shingles")
            flat, sizes = shingles.flatten().to_numpy(), shingles.value_lengths().to_numpy()
            short = flat & np.int64(-1 << 64 - SHORT_BITS)
            found = hot[np.minimum(np.searchsorted(hot, short), len(hot) - 1)] == short
            ranked = np.uint64(31 << 58) | (short[found].view(np.uint64) >> np.uint64(6))
            begins = np.append(0, np.cumsum(found))[np.append(0, np.cumsum(sizes))]
            rows = [*(batch.column(f.name) for f in kept), _lists(ranked.view(np.int64), begins)]
            yield pa.RecordBatch.from_arrays(rows, [*(f.name for f in kept), "common"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return sets.mapInArrow(run, f"{schema}, common array<bigint>")


def _prefixes(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``key``, ``n``, ``root``, ``prefix``: shingles of which a set shares one with any set of another component it links to.

    Shingles of one component alone cannot be shared with another; the rarest of the others come first, in one order for
    all sets. If only as many are left out as a link may miss, each link has one of the first in common.
    Sets of which more are alone are left out. Each shingle goes to the task of its hash once, but for those
    that are very common in a sample of the sets: these, fewer than ``HOT_KEYS``, count as shared and come last.
    """
    rooted = sets.join(broadcast_if_small(roots), "key", "left").withColumn("root", F.coalesce("root", "key"))
    shown = rooted.select("key", "root", F.explode("shingles").alias("h"))
    shown = shown.withColumn("h", F.col("h").bitwiseAND(F.lit(-1 << 64 - SHORT_BITS)))
    drawn = shown.where(F.pmod(F.xxhash64("key"), F.lit(HOT_SAMPLE)) == 0).groupBy("h").agg(F.count(F.lit(1)).alias("rows"))
    drawn = written(drawn, "ngram-drawn")
    total = drawn.agg(F.sum("rows")).first()[0] or 0
    common = drawn.where((F.col("rows") * HOT_KEYS > total) & (F.col("rows") > 1)).select("h")
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = shown.join(F.broadcast(common), "h", "left_anti").select("h", "key", "root")
    dealt = few.repartition(tasks, "h").sortWithinPartitions("h")
    foreign = dealt.mapInArrow(_foreign, "key bigint, ranked bigint")
    # as long as a set; the common shingles are taken from the set's own array and are never rows
    rarest = foreign.groupBy("key").agg(F.sort_array(F.collect_list("ranked")).alias("rarest"))
    hot = np.sort(np.array([r.h for r in common.collect()], np.int64))
    of_set = _with_common(rooted.select("key", "n", "root", "signature", "shingles"), hot).join(rarest, "key", "left")
    ordered = F.concat(F.coalesce("rarest", F.array().cast("array<bigint>")), "common")
    wanted = _spare(F.col("n")) + 1 - (F.col("n") - F.size("ordered"))
    first = F.slice("ordered", F.lit(1), wanted.cast("int"))
    return of_set.withColumn("ordered", ordered).where(wanted > 0).select("key", "n", "root", "signature", first.alias("prefix"))


def _all_pairs(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of different components that share a tile and pass the bound; large tiles go in blocks.

    A pair comes out once: in the tile of its first common shingle and of the larger band. A row of a tile has
    the shingles before the tile's own, for that.
    """
    prefixes = written(_prefixes(sets, roots), "ngram-prefixes")
    tiles = _in_bands(prefixes.select("key", "n", "root", F.posexplode("prefix").alias("place", "h")))
    # a tile without a set of its own band holds only pairs that come out in the tile of their band
    seen = F.count(F.lit(1)).alias("sets"), F.min("root").alias("a"), F.max("root").alias("b"), F.max("own").alias("top")
    sizes = tiles.groupBy("h", "band").agg(*seen).where("a < b AND top = band")
    blocks = tiles.join(sizes.select("h", "band", F.ceil(F.col("sets") / BLOCK).cast("int").alias("blocks")), ["h", "band"]).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    )
    # a block meets itself and every other one: each set is sent once per pair of blocks
    at = ["h", "band", "low", "high"]
    sent = (
        blocks.join(prefixes.select("key", "signature", "prefix"), "key")
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "to"), "high": F.greatest("block", "to")})
        .select(*at, "key", "n", "root", "own", "block", "signature", F.slice("prefix", F.lit(1), F.col("place")).alias("before"))
    )
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(tasks, *at).sortWithinPartitions(*at)
    return written(dealt.mapInArrow(_pairs_of_tiles, "key bigint, other bigint"), "ngram-pairs")


def _pairs_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within each tile, which are rows in a row; a tile cut by the end of a batch is carried over."""
    carried: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(c).to_numpy() for c in ("h", "band", "low", "high")]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in at], axis=0)) + 1
        first = tuple(c[0] for c in at)
        if carried and first != last:
            yield _pairs(carried)
            carried = []
        begin = change[-1] if len(change) else 0
        if begin:
            yield _pairs([*carried, batch.slice(0, begin)])
            carried = []
        carried.append(batch.slice(begin))
        last = tuple(c[-1] for c in at)
    if carried:
        yield _pairs(carried)


def _pairs(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Pairs of different components in whole tiles: each where its first common shingle and larger band are."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    h, band, low, high, key, n, root, own, block = (
        rows.column(c).to_numpy() for c in ("h", "band", "low", "high", "key", "n", "root", "own", "block")
    )
    bits = rows.column("signature").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SIGNATURE_WORDS)
    lists = rows.column("before").combine_chunks()
    flat, cuts = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    earlier: dict[int, set[int]] = {}

    def before(i: int) -> set[int]:
        if i not in earlier:
            earlier[i] = set(flat[cuts[i] : cuts[i + 1]].tolist())
        return earlier[i]

    change = np.any([c[1:] != c[:-1] for c in (h, band, low, high)], axis=0)
    begins = np.flatnonzero(np.append(True, change))
    found: list[tuple[int, int]] = []
    for begin, end in zip(begins, np.append(begins[1:], len(h)), strict=True):
        if end - begin < 2:
            continue
        earlier.clear()
        tile = np.arange(begin, end)
        lower, upper = tile[block[tile] == low[begin]], tile[block[tile] == high[begin]]
        same = low[begin] == high[begin]
        for i in lower:
            others = upper[(root[upper] != root[i]) & (np.maximum(own[upper], own[i]) == band[begin])]
            if same:
                others = others[key[others] > key[i]]
            if not len(others):
                continue
            mine = n[i] - np.bitwise_count(bits[i] & ~bits[others]).sum(axis=1, dtype=np.int64)
            theirs = n[others] - np.bitwise_count(bits[others] & ~bits[i]).sum(axis=1, dtype=np.int64)
            others = others[(100 + PERCENT) * np.minimum(mine, theirs) >= PERCENT * (n[i] + n[others])]
            if not len(others):
                continue
            # a shingle that both have before this one is the place of the pair
            mine = before(i)
            found += [(min(key[i], key[j]), max(key[i], key[j])) for j in others.tolist() if mine.isdisjoint(before(j))]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "other"])


def _sized_and_rooted(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """``_sized`` and the components of its classes, written: nothing that reads them goes to Python."""
    sized = written(_sized(docs, words), "ngram-sized")
    chosen = written(_classes_with_partners(sized, _shown(docs, words)), "ngram-classes")
    sets = _sets_of(docs, chosen, words)
    links = _linked(_pivot_pairs(sets), sets)
    roots = _components(links)
    more = _linked(_all_pairs(sets, roots), sets)
    return sized, roots if more.isEmpty() else _merged(roots, more)


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of word n-grams of 0.8 or more.

    Returns ``doc_id``, ``n_shingles`` (distinct n-grams of the whole text, A-Z as a-z; all words as one if
    there are fewer), ``component_id`` (smallest id reachable by links, its own included), ``text_hash``
    (64 bits of the text) and ``root`` (a number of the component, null without shingles), one row per row
    of ``docs``. Null, empty and blank texts have no shingles and are linked with nothing. Repeated
    rows are in one component; null ids are kept and never the smallest, unless all are null; an empty
    table gives no rows; other columns are not read, whatever their names.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    with batches_of(docs.sparkSession, ROWS_PER_BATCH):
        sized, roots = _sized_and_rooted(docs, words)
    smallest = sized.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("own"))
    joined = smallest.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    of_root = joined.groupBy("root").agg(F.min("own").alias("component_id"))
    of_key = joined.select("key", "root").join(of_root, "root").select("key", "root", "component_id")
    names = "doc_id", "n_shingles", "component_id", "text_hash", "root"
    found = sized.where("n_shingles > 0").join(of_key, "key").select(*names)
    empty = sized.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "root": F.lit(None).cast("bigint")})
    return found.union(empty.select(*names))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Rows of ``docs`` without near copies: of each component the row of the smallest id stays.

    Rows without shingles all stay. Of repeated rows one stays; null ids come last, then the text's
    hash decides. All columns are kept as they are.
    """
    found = written(ngram_components(docs, doc_id, text, words), "ngram-components")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("first")).select("first.*")
    empty = found.where("root IS NULL").select("doc_id", "text_hash").distinct()
    counts = found.where("root IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("t"))
    copied = first.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).join(counts.where("rows > 1"), same).select("d", "t")
    copied = written(copied, "ngram-copied")
    stay = first.select("doc_id", "text_hash").union(empty).select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_text"))

    row = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"))
    known = broadcast_if_small(written(stay, "ngram-stay"))
    kept = row.join(known, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_text")), "left_semi")
    if copied.isEmpty():
        return kept.select("row.*")
    # repeated rows have equal texts and ids: the first one by all columns that can be ordered is as good as any
    again = F.col("id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("t"))
    number = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(0)))
    once = kept.join(copied, again, "left_semi").withColumn("number", number).where("number = 1").select("row.*")
    return kept.join(copied, again, "left_anti").select("row.*").union(once)
