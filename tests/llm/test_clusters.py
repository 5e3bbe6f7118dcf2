"""Centroid clustering, Merkle manifests and SimHash against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlens.llm import graph, merkle, orchard, simhash
from tests.llm.helpers import DOCS, LOWER, WORD, awkward, documents, empty


def draw():
    return F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256)


def smallest_of(nodes, links):
    """Smallest node reachable, by flooding."""
    near = {n: {n} for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


# ---- clustering


def plain_lloyd(rows, clusters, rounds):
    """rows: (id, whole numbers)"""
    drawn = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in rows if i is not None)[:clusters]
    centroids = [v for _, _, v in drawn]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        held = [best(v)[1] for _, v in rows]
        for j in range(len(centroids)):
            own = [v for (_, v), h in zip(rows, held, strict=True) if h == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *reversed(best(v))) for i, v in rows]
    sums = {j: sum(d for _, h, d in found if h == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, sums[j], sum(sums.values()), digest[j]) for i, j, d in found]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


@pytest.mark.parametrize("seed,n,spread", [(1, 300, 3.0), (2, 200, 0.004), (3, 5, 1.0), (4, 150, 0.0)])
def test_clusters(spark, seed, n, spread):
    """Spread, on a grid with many equal distances, fewer rows than clusters, and all rows alike."""
    rng = np.random.default_rng(seed)
    rows = [(i, np.float32(rng.integers(-3, 4, 4) * spread).tolist()) for i in range(n)]
    whole = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows]
    got = orchard.cluster_vectors(table(spark, rows).repartition(5), 8, 4, draw(), width=4, factor=1024)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_lloyd(whole, 8, 4))


def test_clusters_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [5.0, 2.0]), (None, [1.0, 1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0])]
    rows += [(6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, 0.0]), (None, None)]
    df = table(spark, rows).withColumns({c: F.lit(1) for c in ("id", "v", "cluster", "distance", "drawn", "long")})
    got = sorted((tuple(r) for r in orchard.cluster_vectors(df, 2, 3, draw(), width=2, factor=1024).collect()), key=repr)
    whole = [(i, [int(1024 * x) for x in v]) for i, v in rows[:4] + [rows[10]]]
    assert got == sorted(plain_lloyd(whole, 2, 3), key=repr)
    none = orchard.cluster_vectors(table(spark, [(2, None)]), 2, 3, draw(), width=2, factor=1024)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.isEmpty()
    assert orchard.cluster_vectors(table(spark, []), 2, 3, draw(), width=2, factor=1024).isEmpty()
    with pytest.raises(Exception, match="64 bits"):
        orchard.cluster_vectors(table(spark, [(1, [1e30, 1.0]), (2, [1.0, 1.0])]), 1, 1, draw(), width=2, factor=1024).collect()


def test_nearest_compares_few_centroids():
    """Exact at ties, and lists end early: far groups are not compared."""
    rng = np.random.default_rng(5)
    points = (rng.integers(0, 6, (40, 1)) * 10_000 + rng.integers(0, 50, (40, 3))).astype(np.int64)
    points[7] = points[3]
    rows = points[rng.integers(0, 40, 500)] + rng.integers(-3, 4, (500, 3))
    held, distance = orchard.nearest(rows, orchard.Centroids.of(points), np.zeros(500, np.int64))
    all_of = ((rows[:, None] - points[None]) ** 2).sum(axis=2)
    assert (held == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()


# ---- manifest


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return plain_hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Root, and for each leaf its (left, right) siblings by level."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i in range(len(leaves)):
            run = at[i] // 16 * 16
            ways[i].append((level[run : at[i]], level[at[i] + 1 : run + 16]))
        level = [plain_hash(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [a // 16 for a in at]
    return (level[0] if level else None), ways


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r, plain_leaf(r[0], r[3], r[2], r[4], r[1])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = [plain_tree([leaf for _, leaf in groups[s]]) for s in names]
    root, top = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, ways), above in zip(names, trees, top, strict=True):
        for (r, leaf), way in zip(groups[s], ways, strict=True):
            way = way + above
            proof = plain_hash(*(h for left, right in way for h in (*left, *right)))
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = plain_leaf(r[0], r[3], r[2], r[4], r[1] and r[1].translate(LOWER))
            for left, right in way:
                node = plain_hash(*left, node, *right)
            out.append((r[0], leaf, subroot, root, proof, node, node == root))
    return out


def manifest(df):
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(df, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], {"text": small}, tampered)


@pytest.mark.parametrize("counts", [[1], [1, 16, 17], [256, 257, 3], [4500], [1] * 300])
def test_manifest(spark, counts):
    rng = random.Random(sum(counts))
    rows = []
    for s, n in enumerate(counts):
        source = None if s == 1 else f"é{s}" if s % 2 else f"s{s}"
        rows += [(rng.randrange(10**6), rng.choice(["Ab c", "abc", "", None, "ÉX"]), "en", source, rng.choice([None, 3])) for _ in range(n)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_manifest(rows))


def test_manifest_awkward_rows(spark):
    df = awkward(spark).withColumns({c: F.lit("x") for c in ("rank", "hash", "block", "steps", "children", "place", "range", "nodes")})
    rows = [tuple(r)[:5] for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(tuple, manifest(df).collect()), key=repr) == sorted(plain_manifest(rows), key=repr)
    assert manifest(empty(spark)).isEmpty()


def test_a_hot_source_is_many_blocks(spark):
    """Repeated rows of one source spread over ranges and blocks; no block holds more than 256 leaves."""
    df = spark.range(3000).select(
        F.lit(7).cast("bigint").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"),
        F.lit(4).cast("bigint").alias("n_chars"),
    )
    leaves = df.select(F.lit("=hot").alias("key"), F.col("doc_id").alias("id"), F.lit("0" * 64).alias("hash"))
    ranked = merkle._ranked(leaves, ["id", "hash"], "test")
    assert sorted(r.rank for r in ranked.collect()) == list(range(3000))
    assert ranked.groupBy(F.spark_partition_id()).count().count() > 1
    blocks = merkle._tree(ranked, ["id"], "test")[0]
    assert blocks.count() == 12
    assert blocks.select(F.aggregate("children", F.lit(0), lambda n, c: n + F.size(c["children"])).alias("n")).agg(F.max("n")).first()[0] == 256


# ---- SimHash


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_terms_are_in_any_four_positions():
    assert len(simhash.TERMS) == 20
    for shared in range(256):
        assert (simhash.FIRST_TERM[shared] < 20) == (shared.bit_count() >= 4)


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_fingerprints(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE_BYTES", piece)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 5)
    texts = [None, "", " \t", "one", "One TWO three", "a b\x0bc\x1cd e f  g\x85h É", "é中 x " * 50, "w" * 40 + " a b c d e f " + "v" * 33]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


def flipped(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("block,short", [(1024, 16), (8, 4), (3, 2)])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, block, short):
    """Far and near fingerprints, and a dense group whose lists are cut into blocks."""
    monkeypatch.setattr(simhash, "LIST_BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL_LIST", short)
    rng = random.Random(block)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(200)} | {flipped(rng, centre, rng.randint(0, 3)) for _ in range(120)} | {0, 1, 2**64 - 1}
    for f in list(fps)[:100]:
        fps.add(flipped(rng, f, rng.randint(3, 6)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()
    mask = (1 << 64) - 1
    assert all(0 < ((r.a ^ r.b) & mask).bit_count() for r in links)
    want = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4]
    assert smallest_of(fps, [(r.a & mask, r.b & mask) for r in links]) == smallest_of(fps, want)


def test_simhash_components(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(2000)]
    texts = [None, "", " ", "One two", "one TWO"]
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 5, 40])):
            words[rng.randrange(2000)] = "new"
        texts.append(" ".join(words) if i % 7 else " ".join(rng.choice("xyz") for _ in range(i + 1)))
    df = documents(spark, texts).withColumns({c: F.lit("x") for c in ("fp", "key", "own", "rows", "root", "node")})
    rows = simhash.simhash_components(df).collect()
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    want = smallest_of(list(fps), [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {r.doc_id: r.component_id for r in rows} == want


def test_simhash_awkward_rows(spark):
    rows = [tuple(r) for r in simhash.simhash_components(awkward(spark)).collect()]
    assert len(rows) == 10
    zero = [r for r in rows if r[1] == "0" * 16]
    assert len(zero) == 4 and {r[2] for r in zero} == {3}
    assert [r[2] for r in rows if r[0] == 1] == [1, 1]
    assert simhash.simhash_components(empty(spark)).isEmpty()


def test_connected(spark):
    """Paths, stars and hubs of many hubs: smallest nodes, whatever the keys' counts."""
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 500)] + [(499, 1000), (1000, 3), (7, 7)]
    links += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(links, "a bigint, b bigint"), "test").collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == smallest_of(nodes, [p for p in links if p[0] != p[1]])
