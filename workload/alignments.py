"""Alignments: counts, identity, errors, depth, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlens.functions import alignments as sam
from strandlens.functions import cigar as cg
from strandlens.operators import alignments as al
from strandlens.operators import depth as dp
from strandlens.operators import overlap as ov
from strandlens.plans import reports
from workload import views
from workload.oracle import ALL_BASES, ALN, BASES_CTE, BLOCKS, REFS, REGIONS
from workload.reads import histogram_sql, n50_sql
from workload.registry import query

_ALIGNED = "kept AS (SELECT * FROM aln WHERE flag & 260 = 0)"
_CLASSES = """count(*) AS total_reads, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 <> 0) AS unmapped,
       count(*) FILTER (flag & 2308 = 0) AS "primary", count(*) FILTER (flag & 256 <> 0) AS secondary,
       count(*) FILTER (flag & 2048 <> 0) AS supplementary"""


@query(
    f"""WITH {ALN}, {_ALIGNED}, {n50_sql('kept', 'len')},
c AS (SELECT file, {_CLASSES} FROM aln GROUP BY file),
m AS (SELECT file, avg(len) AS mean_length, median(len) AS median_length, round(avg(identity), 6) AS mean_identity,
        round(median(identity), 6) AS median_identity FROM kept GROUP BY file)
SELECT * FROM c JOIN m USING (file) JOIN n50 USING (file)"""
)
def alignment_stats(spark, sf):
    out = al.alignment_stats(views.alignments(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_identity", "median_identity")})


@query(f"WITH {ALN}, {_ALIGNED}, {histogram_sql('kept', 'len', 20)}")
def alignment_length_histogram(spark, sf):
    return al.alignment_length_histogram(views.alignments(spark, sf), 20)


@query(f"WITH {ALN}, {_ALIGNED}, {histogram_sql('kept', 'len', 20, 'len')}")
def alignment_length_histogram_scaled(spark, sf):
    return al.alignment_length_histogram(views.alignments(spark, sf), 20, scaled=True)


_MAPQ = """SELECT file, CAST(mapq AS DOUBLE) AS "start", CAST(mapq + 1 AS DOUBLE) AS "end", {n} AS "count"
FROM kept GROUP BY file, mapq"""


@query(f"WITH {ALN}, {_ALIGNED} {_MAPQ.format(n='count(*)')}")
def mapq_histogram(spark, sf):
    return al.mapq_histogram(views.alignments(spark, sf))


@query(f"WITH {ALN}, {_ALIGNED} {_MAPQ.format(n='CAST(sum(len) AS BIGINT)')}")
def mapq_histogram_scaled(spark, sf):
    return al.mapq_histogram(views.alignments(spark, sf), scaled=True)


@query(f"WITH {ALN} SELECT file, flag, count(*) AS \"count\" FROM aln GROUP BY ALL")
def flag_histogram(spark, sf):
    return al.flag_histogram(views.alignments(spark, sf))


@query(
    f"""WITH {ALN}
SELECT qname, CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 256 <> 0 THEN 'secondary'
                   WHEN flag & 2048 <> 0 THEN 'supplementary' ELSE 'primary' END AS class,
       CASE kind WHEN 'A' THEN 6 WHEN 'B' THEN 1 ELSE 7 END AS ops,
       CAST(CASE kind WHEN 'C' THEN 2 * q + 8 WHEN 'A' THEN 2 * q + 15 ELSE q END AS BIGINT) AS aligned,
       CAST(ins AS BIGINT) AS ins, CAST(del AS BIGINT) AS del, CAST(span AS BIGINT) AS span,
       round(identity, 6) AS identity
FROM aln"""
)
def alignment_scalars(spark, sf):
    s = F.col("c")
    rows = views.alignments(spark, sf).withColumn("c", cg.cigar_summary(F.col("cigar")))
    return rows.select(
        "qname",
        sam.flag_class(F.col("flag")).alias("class"),
        F.size(cg.cigar_ops(F.col("cigar"))).alias("ops"),
        s["aligned"].alias("aligned"),
        s["ins_bases"].alias("ins"),
        s["del_bases"].alias("del"),
        s["ref_span"].alias("span"),
        F.round(cg.identity(s, al.tag("NM").try_cast("bigint"), al.tag("de").try_cast("double")), 6).alias("identity"),
    )


@query(
    f"""WITH {ALN}
SELECT file, qname, CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq,
       CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual
FROM aln WHERE flag & 2304 = 0"""
)
def reads_from_alignments(spark, sf):
    out = al.reads_from_alignments(views.alignments(spark, sf))
    return out.select("file", F.col("read_id").alias("qname"), "seq", "qual")


@query(
    f"""WITH {ALN}, p AS (SELECT *, len AS bases FROM aln WHERE flag & 2308 = 0)
SELECT file, round((sum(nm) - sum(ins) - sum(del)) / sum(bases), 9) AS mismatch_rate,
       round(sum(ins) / sum(bases), 9) AS insertion_rate, round(sum(del) / sum(bases), 9) AS deletion_rate,
       round(sum(nm) / sum(bases), 9) AS error_rate
FROM p GROUP BY file"""
)
def error_rates(spark, sf):
    out = al.error_rates(views.alignments(spark, sf))
    return out.select("file", *[F.round(c, 9).alias(c) for c in out.columns if c != "file"])


# places of mismatches and gaps from the numbers behind the cigars and MD tags, forward and reverse:
# kind A has two mismatches, a deletion and two inserted bases, kind C one mismatch
_MISMATCHES = """SELECT file, k + q AS fwd, size - (k + q - 1) AS back, flag FROM p WHERE kind = 'A'
  UNION ALL SELECT file, k + q + x + 1, size - (k + q + x), flag
    FROM (SELECT *, CASE WHEN q % 2 = 0 THEN q % 7 ELSE q + 8 END AS x FROM p) WHERE kind = 'A'
  UNION ALL SELECT file, q + 1, size - q, flag FROM p WHERE kind = 'C'"""
_GAPS = """UNION ALL SELECT file, k + q AS fwd, size - (k + q) AS back, flag FROM p WHERE kind = 'A'
  UNION ALL SELECT file, k + 2 * q + 6, size - (k + 2 * q + 5), flag FROM p WHERE kind = 'A'
  UNION ALL SELECT file, k + 2 * q + 7, size - (k + 2 * q + 6), flag FROM p WHERE kind = 'A'"""


def _cycle_sql(places: str, name: str) -> str:
    return f"""WITH {ALN}, p AS (SELECT * FROM aln WHERE flag & 2308 = 0), m AS ({places}),
hits AS (SELECT file, CASE WHEN flag & 16 <> 0 THEN back ELSE fwd END AS cycle, count(*) AS n FROM m GROUP BY ALL),
reach AS (SELECT file, unnest(range(1, size + 1)) AS cycle FROM p),
total AS (SELECT file, cycle, count(*) AS reads FROM reach GROUP BY ALL)
SELECT file, cycle, coalesce(n, 0) AS {name}, reads, round(coalesce(n, 0) / reads, 9) AS rate
FROM total LEFT JOIN hits USING (file, cycle)"""


@query(_cycle_sql(_MISMATCHES, "mismatches"))
def mismatch_by_cycle(spark, sf):
    out = al.mismatch_by_cycle(views.alignments(spark, sf))
    return out.withColumn("rate", F.round("rate", 9))


@query(_cycle_sql(f"{_MISMATCHES} {_GAPS}", "errors"))
def errors_by_cycle(spark, sf):
    out = al.errors_by_cycle(views.alignments(spark, sf))
    return out.withColumn("rate", F.round("rate", 9))


@query(
    f"""WITH {ALN} SELECT file, abs(tlen) AS insert_size, count(*) AS "count"
FROM aln WHERE flag & 2308 = 0 AND flag & 67 = 67 AND tlen <> 0 GROUP BY ALL"""
)
def insert_size_histogram(spark, sf):
    return al.insert_size_histogram(views.alignments(spark, sf))


@query(
    f"""WITH {BASES_CTE}, {REFS}, o AS (SELECT *, pos - row_number() OVER (PARTITION BY file, contig, depth ORDER BY pos) AS g FROM perbase)
SELECT file, contig, min(pos) AS "start", max(pos) + 1 AS "end", depth FROM o GROUP BY file, contig, depth, g"""
)
def base_depth(spark, sf):
    return dp.base_depth(_blocks(spark, sf), tile=views.TILE)


@query(
    f"""WITH {ALL_BASES}, o AS (SELECT *, pos - row_number() OVER (PARTITION BY file, contig, depth ORDER BY pos) AS g FROM allbase)
SELECT file, contig, min(pos) AS "start", max(pos) + 1 AS "end", depth FROM o GROUP BY file, contig, depth, g"""
)
def base_depth_with_zeros(spark, sf):
    return dp.base_depth(_blocks(spark, sf), tile=views.TILE, refs=views.references(spark, sf))


def _blocks(spark, sf, **options):
    return dp.aligned_blocks(views.alignments(spark, sf), **options)


_CONTIGS = "contigs AS (SELECT file, contig, any_value(n) AS length, avg(depth) AS mean_depth, median(depth) AS median_depth, min(depth) AS min_depth, max(depth) AS max_depth FROM (SELECT *, count(*) OVER (PARTITION BY file, contig) AS n FROM allbase) GROUP BY file, contig)"


@query(f"WITH {ALL_BASES}, {_CONTIGS} SELECT file, contig, length, round(mean_depth, 9) AS mean_depth FROM contigs")
def coverage_by_contig(spark, sf):
    out = dp.coverage_by_contig(_blocks(spark, sf), views.references(spark, sf))
    return out.withColumn("mean_depth", F.round("mean_depth", 9))


@query(
    f"""WITH {BLOCKS}, {REFS}, low AS (SELECT file, contig, pos, pos + span AS e FROM aln WHERE flag & 1796 = 0 AND mapq >= 30),
n AS (SELECT file, contig, sum(e - pos) AS bases FROM low GROUP BY ALL)
SELECT file, contig, length, round(coalesce(bases, 0) / length, 9) AS mean_depth FROM refs LEFT JOIN n USING (file, contig)"""
)
def coverage_fast_mode(spark, sf):
    blocks = _blocks(spark, sf, fast_mode=True, min_mapq=30)
    return dp.coverage_by_contig(blocks, views.references(spark, sf)).withColumn("mean_depth", F.round("mean_depth", 9))


@query(f"WITH {ALL_BASES}, {_CONTIGS} SELECT file, contig, median_depth, min_depth, max_depth FROM contigs")
def median_depth(spark, sf):
    return dp.median_depth(dp.base_depth(_blocks(spark, sf), tile=views.TILE, refs=views.references(spark, sf), merge=False))


@query(
    f"""WITH {ALL_BASES}, {_CONTIGS}
SELECT file, round(sum(mean_depth * length) / sum(length), 9) AS mean_depth, round(avg(mean_depth), 9) AS mean_depth_unweighted
FROM contigs GROUP BY file"""
)
def coverage_summary(spark, sf):
    out = dp.coverage_summary(dp.coverage_by_contig(_blocks(spark, sf), views.references(spark, sf)))
    return out.select("file", *[F.round(c, 9).alias(c) for c in ("mean_depth", "mean_depth_unweighted")])


@query(
    f"""WITH {ALL_BASES}, {_CONTIGS}, t AS (SELECT avg(mean_depth) AS x FROM contigs)
SELECT file, contig, CAST(0 AS BIGINT) AS "start", length AS "end", round(mean_depth, 9) AS mean_depth
FROM contigs WHERE mean_depth < 5"""
)
def low_coverage(spark, sf):
    out = dp.low_coverage(dp.coverage_by_contig(_blocks(spark, sf), views.references(spark, sf)), 5)
    return out.withColumn("mean_depth", F.round("mean_depth", 9))


@query(
    f"""WITH {ALL_BASES}
SELECT file, contig, (pos // 300) * 300 AS "start", max(pos) + 1 AS "end", round(avg(depth), 9) AS mean_depth
FROM allbase GROUP BY file, contig, pos // 300"""
)
def window_coverage(spark, sf):
    out = dp.window_coverage(_blocks(spark, sf), views.references(spark, sf), 300)
    return out.withColumn("mean_depth", F.round("mean_depth", 9))


@query(
    f"""WITH {ALL_BASES}, l AS (
  SELECT *, CASE WHEN depth < 1 THEN '0:1' WHEN depth < 10 THEN '1:10' WHEN depth < 30 THEN '10:30'
                 WHEN depth < 100 THEN '30:100' ELSE '100:inf' END AS label FROM allbase),
o AS (SELECT *, pos - row_number() OVER (PARTITION BY file, contig, label ORDER BY pos) AS g FROM l)
SELECT file, contig, min(pos) AS "start", max(pos) + 1 AS "end", label FROM o GROUP BY file, contig, label, g"""
)
def quantized_coverage(spark, sf):
    return dp.quantized_coverage(_blocks(spark, sf), views.references(spark, sf), "0:1:10:30:100:", tile=views.TILE)


@query(f"WITH {BASES_CTE} SELECT file, depth, count(*) AS bases FROM perbase GROUP BY ALL")
def depth_histogram(spark, sf):
    return dp.depth_histogram(dp.base_depth(_blocks(spark, sf), tile=views.TILE, merge=False))


@query(
    f"""WITH {ALL_BASES}, w AS (SELECT file, contig, (pos // 50) * 50 AS s, avg(depth) AS d FROM allbase GROUP BY ALL),
g AS (SELECT file, contig, (pos // 50) * 50 AS s, sum(length(seq) - length(translate(seq, 'GC', ''))) AS gc, sum(length(seq)) AS n
      FROM aln WHERE flag & 1796 = 0 GROUP BY ALL)
SELECT file, round(100.0 * CAST(gc AS DOUBLE) / CAST(n AS DOUBLE), 1) AS gc_pct, count(*) AS windows, round(avg(d), 6) AS mean_depth
FROM w JOIN g USING (file, contig, s) GROUP BY ALL"""
)
def gc_coverage(spark, sf):
    out = dp.gc_coverage(views.alignments(spark, sf), views.references(spark, sf), 50)
    return out.withColumn("mean_depth", F.round("mean_depth", 6))


_TARGETS = f"""WITH {BASES_CTE}, {REGIONS}, spans AS (SELECT DISTINCT contig, s, e FROM regions),
every AS (SELECT f AS file, contig, s, e FROM spans, (VALUES ('F'), ('O')) v(f)),
d AS (SELECT file, contig, s, e, pos, coalesce(depth, 0) AS depth
      FROM (SELECT *, unnest(range(s, e)) AS pos FROM every) LEFT JOIN perbase USING (file, contig, pos)),
t AS (SELECT file, contig, s AS "start", e AS "end", avg(depth) AS mean_depth, min(depth) AS min_depth, max(depth) AS max_depth,
        sum(depth) AS bases, 100 * avg(CAST(depth >= 1 AS INT)) AS pct_coverage_1x, 100 * avg(CAST(depth >= 10 AS INT)) AS pct_coverage_10x,
        100 * avg(CAST(depth >= 20 AS INT)) AS pct_coverage_20x FROM d GROUP BY file, contig, s, e)"""
_OPTIONS = {"tile": views.TILE, "bin_size": views.BIN}
_PCT = "round(pct_coverage_1x, 6) AS pct_coverage_1x, round(pct_coverage_10x, 6) AS pct_coverage_10x, round(pct_coverage_20x, 6) AS pct_coverage_20x"


def _rounded(df):
    names = [c for c in df.columns if c.startswith("pct_") or c == "mean_depth"]
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(f"{_TARGETS} SELECT file, contig, \"start\", \"end\", round(mean_depth, 6) AS mean_depth, min_depth, max_depth, {_PCT} FROM t")
def targeted_coverage(spark, sf):
    return _rounded(
        ov.targeted_coverage(_blocks(spark, sf), views.regions(spark, sf), inputs=views.inputs(spark, sf), **_OPTIONS)
    )


@query(f"{_TARGETS} SELECT file, contig, \"start\", \"end\", round(mean_depth, 6) AS mean_depth, min_depth, max_depth, {_PCT} FROM t")
def targeted_coverage_shuffled(spark, sf):
    """The way taken when there are too many regions to broadcast."""
    return _rounded(
        ov.targeted_coverage(
            _blocks(spark, sf), views.regions(spark, sf), inputs=views.inputs(spark, sf), broadcast_rows=0, **_OPTIONS
        )
    )


@query(f"{_TARGETS} SELECT file, contig, \"start\", \"end\", {_PCT} FROM t")
def threshold_coverage(spark, sf):
    return _rounded(
        ov.threshold_coverage(_blocks(spark, sf), views.regions(spark, sf), inputs=views.inputs(spark, sf), **_OPTIONS)
    )


@query(f"{_TARGETS} SELECT file, contig, \"start\", \"end\", CAST(bases AS BIGINT) AS bases FROM t")
def bedcov(spark, sf):
    return ov.bedcov(_blocks(spark, sf), views.regions(spark, sf), inputs=views.inputs(spark, sf), **_OPTIONS)


_NAMES = """names AS (SELECT contig, s AS "start", e AS "end",
  arg_max(coalesce(name, contig || ':' || s || '-' || e), line_no) AS region_name FROM regions GROUP BY ALL)"""


@query(
    f"""{_TARGETS}, {_NAMES}
SELECT file, contig, "start", "end", region_name, round(mean_depth, 6) AS mean_depth, min_depth, max_depth, {_PCT}
FROM t JOIN names USING (contig, "start", "end")"""
)
def targeted_coverage_report(spark, sf):
    return _rounded(
        reports.targeted_coverage_report(
            views.alignments(spark, sf), views.regions(spark, sf), inputs=views.inputs(spark, sf), **_OPTIONS
        )
    )


def _rates_sql(name: str, places: str, column: str) -> str:
    """Rates per ten thousand of each cycle in order, as text."""
    return f"""{name}_m AS ({places}),
{name}_hits AS (SELECT file, CASE WHEN flag & 16 <> 0 THEN back ELSE fwd END AS cycle, count(*) AS n FROM {name}_m GROUP BY ALL),
{name}_total AS (SELECT file, cycle, count(*) AS reads FROM (SELECT file, unnest(range(1, size + 1)) AS cycle FROM p) GROUP BY ALL),
{name} AS (SELECT file, string_agg(CAST(floor(coalesce(n, 0) / reads * 10000 + 1e-6) AS BIGINT), ',' ORDER BY cycle) AS {column}
  FROM {name}_total LEFT JOIN {name}_hits USING (file, cycle) GROUP BY file)"""


@query(
    f"""WITH {ALL_BASES}, {_ALIGNED}, {n50_sql('kept', 'len')},
h AS (SELECT file, max(len) // 2000 + 1 AS length_bins, count(DISTINCT mapq) AS mapqs FROM kept GROUP BY file),
c AS (SELECT file, avg(depth) AS d, median(depth) AS m, count(DISTINCT depth) AS depths FROM allbase GROUP BY file),
l AS (SELECT file, count(*) FILTER (d < 5) AS low_contigs, max(m) AS best FROM (
        SELECT file, contig, avg(depth) AS d, median(depth) AS m FROM allbase GROUP BY ALL) GROUP BY file),
e AS (SELECT file, (sum(nm) - sum(ins) - sum(del)) / sum(len) AS mismatch, max(size) AS cycles FROM aln WHERE flag & 2308 = 0 GROUP BY file),
x AS (SELECT file, {_CLASSES} FROM aln GROUP BY file),
lh AS (SELECT file, string_agg(b || ':' || n, ',' ORDER BY b) AS lengths FROM (
        SELECT file, len // 2000 * 2000 AS b, count(*) AS n FROM kept GROUP BY ALL) GROUP BY file),
mh AS (SELECT file, string_agg(b || ':' || n, ',' ORDER BY b) AS mapq_counts FROM (
        SELECT file, mapq AS b, count(*) AS n FROM kept GROUP BY ALL) GROUP BY file),
ch AS (SELECT file, string_agg(b || ':' || n, ',' ORDER BY b) AS depth_bases FROM (
        SELECT file, depth AS b, count(*) AS n FROM perbase GROUP BY ALL) GROUP BY file),
ih AS (SELECT file, string_agg(b || ':' || n, ',' ORDER BY b) AS insert_sizes FROM (
        SELECT file, abs(tlen) AS b, count(*) AS n FROM aln WHERE flag & 2308 = 0 AND flag & 67 = 67 AND tlen <> 0 GROUP BY ALL) GROUP BY file),
p AS (SELECT * FROM aln WHERE flag & 2308 = 0), {_rates_sql('mm', _MISMATCHES, 'mismatch_rates')},
{_rates_sql('ee', _MISMATCHES + ' ' + _GAPS, 'error_rates')}
SELECT file, total_reads, mapped, n50, length_bins, mapqs, round(d, 6) AS mean_depth, m AS median_depth, depths, low_contigs,
       best, round(mismatch, 9) AS mismatch_rate, cycles, lengths, mapq_counts, depth_bases, insert_sizes, mismatch_rates, error_rates
FROM x JOIN n50 USING (file) JOIN h USING (file) JOIN c USING (file) JOIN l USING (file) JOIN e USING (file)
  JOIN lh USING (file) JOIN mh USING (file) JOIN ch USING (file) JOIN ih USING (file) JOIN mm USING (file) JOIN ee USING (file)"""
)
def alignment_summary(spark, sf):
    out = reports.alignment_summary(
        views.alignments(spark, sf),
        views.references(spark, sf),
        include_error_profile=True,
        coverage_options={"low_cov_threshold": 5, "tile": views.TILE},
    )

    def size(path):
        return F.size(path).cast("bigint")

    def bins(path):
        filled = F.filter(path, lambda b: b["count"] > 0)
        return F.array_join(F.transform(filled, lambda b: F.concat_ws(":", b["start"].cast("bigint"), b["count"])), ",")

    def rates(path):
        return F.array_join(F.transform(path, lambda r: F.floor(r * 10000 + 1e-6)), ",")

    return out.select(
        "file",
        bins("alignment.length_histogram").alias("lengths"),
        bins("alignment.mapq_histogram").alias("mapq_counts"),
        bins("errors.coverage_histogram").alias("depth_bases"),
        bins("errors.insert_size_histogram").alias("insert_sizes"),
        rates("errors.mismatch_by_cycle").alias("mismatch_rates"),
        rates("errors.error_by_position").alias("error_rates"),
        "alignment.total_reads",
        "alignment.mapped",
        "alignment.n50",
        size("alignment.length_histogram").alias("length_bins"),
        size("alignment.mapq_histogram").alias("mapqs"),
        F.round("coverage.mean_depth", 6).alias("mean_depth"),
        "coverage.median_depth",
        size("coverage.coverage_distribution").alias("depths"),
        size("coverage.low_coverage_regions").alias("low_contigs"),
        F.array_max(F.transform("coverage.coverage_by_contig", lambda c: c["median_depth"])).alias("best"),
        F.round("errors.mismatch_rate", 9).alias("mismatch_rate"),
        size("errors.mismatch_by_cycle").alias("cycles"),
    )
