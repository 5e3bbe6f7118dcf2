"""Targets by gene and location through to coverage, features at any depth, and the presets of reports and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlens.operators import genes
from strandlens.plans import reports
from strandlens.plans.presets import preset
from workload import views
from workload.alignments import _ALIGNED, _MAPQ, _OPTIONS, _rounded
from workload.oracle import ALL_BASES, ALN, BASES_CTE, REFS
from workload.registry import query


def _on_contigs(spark, sf):
    """A gene of 500 bases for each region, on the contigs of the alignments."""
    return views.table(spark, sf, "region").selectExpr(
        "'g' file", "cast(r_regionkey as bigint) line_no", "substr('ANRZY', r_regionkey + 1, 1) seqid", "'gene' type",
        "cast(r_regionkey * 100 + 1 as bigint) start", "cast(r_regionkey * 100 + 500 as bigint) end",
        "map('ID', concat('G', r_regionkey), 'id', concat('g', r_regionkey), 'name', r_name) attrs",
    )


def _coverage_sql(spans: str) -> str:
    return f"""WITH {BASES_CTE}, spans AS ({spans}), every AS (SELECT f AS file, s.* FROM spans s, (VALUES ('F'), ('O')) v(f)),
d AS (SELECT file, contig, s, e, name, coalesce(depth, 0) AS depth
      FROM (SELECT *, unnest(range(s, e)) AS pos FROM every) LEFT JOIN perbase USING (file, contig, pos))
SELECT file, contig, s AS "start", e AS "end", name AS region_name, round(avg(depth), 6) AS mean_depth, min(depth) AS min_depth,
       max(depth) AS max_depth, round(100 * avg(CAST(depth >= 1 AS INT)), 6) AS pct_coverage_1x,
       round(100 * avg(CAST(depth >= 10 AS INT)), 6) AS pct_coverage_10x, round(100 * avg(CAST(depth >= 20 AS INT)), 6) AS pct_coverage_20x
FROM d GROUP BY ALL"""


def _covered(spark, sf, **target):
    regions = reports.target_regions(spark, one_based=True, **target)
    return _rounded(reports.targeted_coverage_report(views.alignments(spark, sf), regions, inputs=views.inputs(spark, sf), **_OPTIONS))


@query(
    _coverage_sql(
        """SELECT substr('ANRZY', r_regionkey + 1, 1) AS contig, CAST(r_regionkey * 100 AS BIGINT) AS s,
          CAST(r_regionkey * 100 + 500 AS BIGINT) AS e, lower(r_name) AS name FROM region WHERE r_regionkey = 1"""
    )
)
def gene_coverage(spark, sf):
    """Coverage of a gene found by its name, in any case."""
    name = views.table(spark, sf, "region").where("r_regionkey = 1").first().r_name.lower()
    return _covered(spark, sf, gene=name, features=_on_contigs(spark, sf))


@query(_coverage_sql("SELECT 'R' AS contig, CAST(200 AS BIGINT) AS s, CAST(900 AS BIGINT) AS e, 'R:201-900' AS name"))
def location_coverage(spark, sf):
    """Coverage of a location as typed."""
    return _covered(spark, sf, location="R:201-900")


# ---- features: genes of regions, transcripts of nations, one part of a transcript per supplier, and an exon per customer with two parents


def _deep_features(spark, sf):
    suppliers = views.table(spark, sf, "supplier")
    top = views.features(spark, sf).where(F.lower("type").isin("gene", "mrna", "transcript"))
    parts = suppliers.selectExpr(
        "'g' file", "10000 + s_suppkey line_no", "concat('chr', s_nationkey) seqid", "'match_part' type", "s_suppkey * 10 + 1 start",
        "s_suppkey * 10 + 8 end", "map('id', concat('part', s_suppkey), 'parent', concat('Tx', s_nationkey)) attrs",
    )
    of_nation = suppliers.groupBy("s_nationkey").agg(F.max("s_suppkey").alias("last"))
    exons = views.table(spark, sf, "customer").join(of_nation, F.col("c_nationkey") == F.col("s_nationkey"), "left").selectExpr(
        "'g' file", "1000000 + c_custkey line_no", "concat('chr', c_nationkey) seqid", "'exon' type", "c_custkey * 3 start", "c_custkey * 3 + 2 end",
        """map('id', concat('exon', c_custkey),
               'parent', concat_ws(', ', concat('TX', pmod(c_custkey, 25)), concat('part', last))) attrs""",
    )
    return top.unionByName(parts).unionByName(exons)


@query(
    """WITH RECURSIVE f AS (
  SELECT 1000 + n_nationkey AS line_no, 'tx' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'mRNA' ELSE 'transcript' END AS type,
         'gene' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 10000 + s_suppkey, 'part' || s_suppkey, 'match_part', 'tx' || s_nationkey FROM supplier
  UNION ALL SELECT 1000000 + c_custkey, 'exon' || c_custkey, 'exon', 'tx' || (c_custkey % 25) FROM customer
  UNION ALL SELECT 1000000 + c_custkey, 'exon' || c_custkey, 'exon', 'part' || last FROM customer
    JOIN (SELECT s_nationkey, max(s_suppkey) AS last FROM supplier GROUP BY s_nationkey) ON c_nationkey = s_nationkey),
walk AS (
  SELECT 'gene' || r_regionkey AS gene, f.*, 1 AS depth FROM region JOIN f ON f.parent = 'gene' || r_regionkey
  UNION ALL SELECT gene, f.*, depth + 1 FROM walk JOIN f ON f.parent = walk.id)
SELECT 'g' AS file, gene, line_no, type, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY gene, line_no, type"""
)
def gene_descendants(spark, sf):
    """All features below each gene: transcripts, their parts, and exons of either."""
    names = views.table(spark, sf, "region").select(F.concat(F.lit("gene"), F.col("r_regionkey").cast("string")).alias("gene"))
    return genes.gene_descendants(_deep_features(spark, sf), names).select("file", "gene", "line_no", "type", "depth")


# ---- presets


def _bins(path):
    filled = F.filter(path, lambda b: b["count"] > 0)
    return F.array_join(F.transform(filled, lambda b: F.concat_ws(":", b["start"].cast("bigint"), b["count"])), ",")


_JOINED = "string_agg(CAST(\"start\" AS BIGINT) || ':' || \"count\", ',' ORDER BY \"start\") FILTER (\"count\" > 0)"


@query(
    f"""WITH {ALN}, {_ALIGNED},
p AS (SELECT file, len // 2000 * 2000 AS b, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM kept GROUP BY ALL),
m AS (SELECT file, mapq AS b, CAST(sum(len) AS BIGINT) AS bases FROM kept GROUP BY ALL)
SELECT file, string_agg(b || ':' || n, ',' ORDER BY b) AS lengths, string_agg(b || ':' || bases, ',' ORDER BY b) AS bases,
       any_value(mapqs) AS mapqs, true AS flags_left_out
FROM p JOIN (SELECT file, string_agg(b || ':' || bases, ',' ORDER BY b) AS mapqs FROM m GROUP BY file) USING (file) GROUP BY file"""
)
def preset_with_hist_scaled(spark, sf):
    report = reports.alignment_report(views.alignments(spark, sf), **preset("alignment_report", "with_hist_scaled"))
    return report.select(
        "file", _bins("length_histogram").alias("lengths"), _bins("length_histogram_scaled").alias("bases"),
        _bins("mapq_histogram_scaled").alias("mapqs"), F.col("flag_histogram").isNull().alias("flags_left_out"),
    )


@query(
    f"""WITH {ALN}, {_ALIGNED}, m AS ({_MAPQ.format(n='count(*)')}),
f AS (SELECT file, flag AS "start", count(*) AS "count" FROM aln GROUP BY ALL)
SELECT file, mapqs, flags, true AS scaled_left_out FROM (SELECT file, {_JOINED} AS mapqs FROM m GROUP BY file)
JOIN (SELECT file, {_JOINED} AS flags FROM f GROUP BY file) USING (file)"""
)
def preset_with_flags_and_mapq(spark, sf):
    report = reports.alignment_report(views.alignments(spark, sf), **preset("alignment_report", "with_flags_and_mapq"))
    scaled = F.col("length_histogram_scaled").isNull() & F.col("mapq_histogram_scaled").isNull()
    return report.select("file", _bins("mapq_histogram").alias("mapqs"), _bins("flag_histogram").alias("flags"), scaled.alias("scaled_left_out"))


def _tables(spark, sf, name):
    return reports.coverage_tables(views.alignments(spark, sf), views.references(spark, sf), tile=views.TILE, **preset("coverage_tables", name))


@query(
    f"""WITH {ALL_BASES}
SELECT file, contig, (pos // 1000) * 1000 AS "start", max(pos) + 1 AS "end", round(avg(depth), 9) AS mean_depth
FROM allbase GROUP BY file, contig, pos // 1000"""
)
def preset_window_1kb(spark, sf):
    return _tables(spark, sf, "window_1kb")["windows"].withColumn("mean_depth", F.round("mean_depth", 9))


@query(
    f"""WITH {ALN}, {REFS}, fast AS (SELECT file, contig, unnest(range(pos, pos + span)) AS pos FROM aln WHERE flag & 1796 = 0),
n AS (SELECT file, contig, pos, count(*) AS depth FROM fast GROUP BY ALL),
l AS (SELECT r.file, r.contig, r.pos, coalesce(depth, 0) AS depth FROM (SELECT file, contig, unnest(range(0, length)) AS pos FROM refs) r
      LEFT JOIN n USING (file, contig, pos)),
c AS (SELECT *, CASE WHEN depth < 1 THEN '0:1' WHEN depth < 10 THEN '1:10' WHEN depth < 30 THEN '10:30'
                     WHEN depth < 100 THEN '30:100' ELSE '100:inf' END AS label FROM l),
o AS (SELECT *, pos - row_number() OVER (PARTITION BY file, contig, label ORDER BY pos) AS g FROM c)
SELECT file, contig, min(pos) AS "start", max(pos) + 1 AS "end", label FROM o GROUP BY file, contig, label, g"""
)
def preset_fast_quantized(spark, sf):
    """Runs of whole reference spans, gaps of the cigar included."""
    return _tables(spark, sf, "fast_quantized")["quantized"]
