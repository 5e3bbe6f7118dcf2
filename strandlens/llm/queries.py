"""One query per operator over its whole table, with SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlens.llm import ann, bpe, exact_topk, html, merkle, mixing, ngram_join, orchard, secrets, sharding, simhash, toxicity, urls
from strandlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CAPITALS, SMALL_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# The rules of the url query.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query(
    "op2_url_filter",
    """
    WITH cut AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN
            regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
        FROM pages),
    parts AS (
        SELECT page_id,
            coalesce(translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')
                AS host,
            coalesce(substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1), '') AS path
        FROM cut),
    rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) r(rule_host, rule_path, rule_verdict)),
    best AS (
        SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
            row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
        FROM parts LEFT JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM best WHERE place = 1
    """,
)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op3_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op4_sharding")
def document_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


@query("op5_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), RANKS)


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op9_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans")


@query("op10_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


@query(
    "op8_va_file_topk",
    """
    WITH rows AS (
        SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    pairs AS (
        SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
        FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM pairs QUALIFY rank <= 5
    """,
)
def va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search_scaled(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


@query("op7_nn_descent")
def nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_neighbours(table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def _lloyd_sql(clusters: int, rounds: int, width: int) -> str:
    """Rounds one after another: every row beside every centroid, the nearest one, floors of means."""
    steps = [
        f"""
        kept AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {width}
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        c0 AS (
            SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c
            FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {clusters})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
        near{i} AS MATERIALIZED (
            SELECT vec_id, v, cluster, CAST(distance AS BIGINT) AS distance FROM (
                SELECT vec_id, v, cluster, list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, {width + 1})]) AS distance
                FROM kept, c{i})
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""
        sums{i} AS (
            SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM near{i}, (SELECT unnest(range(1, {width + 1})) AS i)
            GROUP BY cluster, i),
        means{i} AS (
            SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM sums{i} GROUP BY cluster),
        c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN means{i} USING (cluster))""")
    return f"""
        WITH {",".join(steps)}
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM near{rounds} JOIN c{rounds} USING (cluster)"""


@query("op11_orchard_clustering", _lloyd_sql(8, 10, 64))
def orchard_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return orchard.cluster_vectors(table(spark, sf_dir, "embeddings"), 8, 10, draw, width=64, factor=1024)


def _merkle_sql(levels: int, source_levels: int) -> str:
    """All levels of all trees, each as a table of its own; trees may have 16^levels leaves and 16^source_levels sources."""
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]
    leaf = "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in (*fields, "{t}")) + ")"
    small = f"translate(text, '{CAPITALS}', '{SMALL_LETTERS}')"
    # crc32 of a short text, bit by bit: a number below zero is a shift
    crc = """xor(list_reduce([4294967295] || flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""

    def climb(name: str, count: int) -> list[str]:
        """``name0`` (k, r, id, h) to the root: parents of the nodes, and siblings of each along the way."""
        out = []
        for i in range(count):
            out.append(f"""
        {name}{i + 1} AS MATERIALIZED (
            SELECT k, r // 16 AS r, CASE WHEN more THEN sha256(string_agg(h, '' ORDER BY r)) ELSE min(h) END AS h
            FROM (SELECT *, count(*) OVER (PARTITION BY k) > 1 AS more FROM {name}{i}) GROUP BY k, r // 16, more),
        {name}s{i} AS MATERIALIZED (
            SELECT a.k, a.r, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS l,
                coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS g, bool_or(m.n > 1) AS up
            FROM {name}{i} a JOIN {name}{i} b ON a.k = b.k AND a.r // 16 = b.r // 16
                JOIN (SELECT k, count(*) AS n FROM {name}{i} GROUP BY k) m ON m.k = a.k GROUP BY a.k, a.r)""")
        return out

    steps = [
        f"""
        docs AS MATERIALIZED (
            SELECT doc_id, coalesce('=' || source, '') AS k, {leaf.format(t="text")} AS leaf,
                CASE WHEN {crc} % 5 = 0 THEN {leaf.format(t=small)} ELSE {leaf.format(t="text")} END AS start
            FROM documents),
        placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM docs),
        a0 AS (SELECT k, r, leaf AS h FROM placed)""",
        *climb("a", levels),
        f"""
        b0 AS MATERIALIZED (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS r, h, k AS source FROM a{levels})""",
        *climb("b", source_levels),
        """
        f0 AS (SELECT p.*, start AS f, '' AS proof, b0.h AS subroot, b0.r AS place FROM placed p JOIN b0 ON b0.source = p.k)""",
    ]
    fold = [("a", "f.k", "f.r", i) for i in range(levels)] + [("b", "''", "f.place", i) for i in range(source_levels)]
    for n, (name, k, r, i) in enumerate(fold):
        steps.append(f"""
        f{n + 1} AS MATERIALIZED (
            SELECT f.* REPLACE (CASE WHEN s.up THEN sha256(s.l || f.f || s.g) ELSE f.f END AS f, f.proof || s.l || s.g AS proof)
            FROM f{n} f JOIN {name}s{i} s ON s.k = {k} AND s.r = {r} // {16**i})""")
    return f"""
        WITH {",".join(steps)}
        SELECT doc_id, leaf, subroot, b{source_levels}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b{source_levels}.h AS verified
        FROM f{len(fold)}, b{source_levels}"""


@query("op12_merkle_manifest", _merkle_sql(6, 3))
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.translate("text", CAPITALS, SMALL_LETTERS)
    return merkle.manifest(
        table(spark, sf_dir, "documents"),
        "doc_id",
        "source",
        ["doc_id", "source", "lang", "n_chars", "text"],
        changed={"text": small},
        tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
    )


@query("op13_simhash")
def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))
