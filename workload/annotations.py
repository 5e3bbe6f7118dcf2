"""Intervals, genes, variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlens.functions import regions as rg
from strandlens.functions import text as tx
from strandlens.functions import variants as vf
from strandlens.operators import genes
from strandlens.operators import intervals as iv
from strandlens.operators import variants as vr
from strandlens.plans.reports import target_regions
from workload import views
from workload.oracle import REGIONS, VARIANTS
from workload.registry import query

# which check fails, from the rule that made the line and not from its text
BED = r"""bed AS (
  SELECT p_type AS file, p_partkey AS line_no, p_size AS size, p_name AS name, p_partkey AS k,
         CASE WHEN p_partkey % 11 = 3 THEN 'few' WHEN p_partkey % 11 = 5 THEN 'start' WHEN p_partkey % 11 = 7 THEN 'end'
              WHEN p_partkey % 11 = 9 THEN CASE WHEN p_size >= 20 THEN 'order' ELSE 'ok20' END ELSE 'ok' END AS kind
  FROM part WHERE p_partkey % 13 <> 0)"""


@query(
    f"""WITH {BED}
SELECT file, count(*) AS total_intervals, count(*) FILTER (kind IN ('ok', 'ok20')) AS valid_intervals,
       CAST(coalesce(sum(CASE kind WHEN 'ok' THEN size WHEN 'ok20' THEN 20 - size END), 0) AS BIGINT) AS total_bases,
       count(*) FILTER (kind NOT IN ('ok', 'ok20')) = 0 AS is_valid
FROM bed GROUP BY file"""
)
def bed_qc(spark, sf):
    return iv.bed_qc(iv.check_bed_lines(views.bed_lines(spark, sf)))


@query(
    f"""WITH {BED}
SELECT file, line_no AS line_number,
       CASE kind WHEN 'few' THEN 'chr1' || chr(9) || size WHEN 'start' THEN 'chr1' || chr(9) || 'abc' || chr(9) || size || chr(9) || 'x'
         WHEN 'end' THEN 'chr2' || chr(9) || size || chr(9) || '7.5'
         ELSE 'chr3' || chr(9) || size || chr(9) || '20' || chr(9) || name END AS line_content,
       CASE kind WHEN 'few' THEN 'needs contig, start and end'
         WHEN 'start' THEN 'start is no whole number: abc' WHEN 'end' THEN 'end is no whole number: 7.5'
         ELSE 'start ' || size || ' is not below end 20' END AS issue
FROM bed WHERE kind NOT IN ('ok', 'ok20')"""
)
def bed_issues(spark, sf):
    return iv.bed_issues(iv.check_bed_lines(views.bed_lines(spark, sf)))


@query(
    f"""WITH {REGIONS}
SELECT line_no, s - CASE WHEN e - s < 21 THEN (21 - (e - s)) // 2 ELSE 0 END AS "start",
       e + CASE WHEN e - s < 21 THEN 21 - (e - s) - (21 - (e - s)) // 2 ELSE 0 END AS "end",
       contig || ':' || s || '-' || e AS region_name,
       CASE WHEN name IS NULL THEN contig || '_' || s || '_' || e || '.png' ELSE name || '.png' END AS snapshot_name
FROM regions"""
)
def region_shapes(spark, sf):
    r = views.regions(spark, sf)
    start, end = rg.expand_region(F.col("start"), F.col("end"), 21)
    place = (F.col("contig"), F.col("start"), F.col("end"))
    return r.select(
        "line_no",
        start.alias("start"),
        end.alias("end"),
        rg.region_name(*place).alias("region_name"),
        rg.snapshot_name(F.when(F.col("line_no") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit(".SVG"))), *place).alias(
            "snapshot_name"
        ),
    )


@query(
    """SELECT s_suppkey, 'chr' || s_nationkey AS contig, CAST(s_suppkey AS BIGINT) AS "start", CAST(s_suppkey + 100 AS BIGINT) AS "end",
       'chr' || s_nationkey || ':' || s_suppkey || '-' || (s_suppkey + 100) || CASE WHEN s_suppkey % 2 = 0 THEN ':x' ELSE '' END AS name
FROM supplier"""
)
def parse_location(spark, sf):
    text = F.expr(
        "concat('chr', s_nationkey, ':', s_suppkey, '-', s_suppkey + 100, CASE WHEN s_suppkey % 2 = 0 THEN ':x' ELSE '' END)"
    )
    rows = views.table(spark, sf, "supplier").select("s_suppkey", rg.parse_location(text).alias("r"))
    return rows.select("s_suppkey", "r.*")


@query(
    """SELECT doc_id, regexp_matches(text, '[\\x00-\\x1f\\x7f-\\x{9f}]') AS has_control FROM documents"""
)
def control_chars(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", tx.has_control_chars(F.col("text")).alias("has_control"))


_ALLELES = """alleles AS (
  SELECT file, chrom, pos, size, ref, qual, g1, g2, a.alt, a.i FROM variants,
    unnest([{'alt': alt1, 'i': 1}, {'alt': CASE WHEN has_del THEN '<DEL>' END, 'i': 2},
            {'alt': CASE WHEN has_star THEN '*' END, 'i': CASE WHEN has_del THEN 3 ELSE 2 END}]) u(a)
  WHERE a.alt IS NOT NULL),
classed AS (
  SELECT *, CASE WHEN alt IN ('<DEL>', '*') THEN 'other' WHEN length(ref) <> length(alt) THEN 'indel'
                 WHEN length(ref) = 1 THEN 'snp' ELSE 'mnp' END AS class,
         CASE WHEN length(ref) = 1 AND length(alt) = 1 AND alt <> '*'
              THEN CASE WHEN ref || alt IN ('AG', 'GA', 'CT', 'TC') THEN 'ts' ELSE 'tv' END END AS change,
         CASE WHEN i = 1 THEN g1 + CASE WHEN g2 = 2 THEN 1 ELSE 0 END WHEN i = 2 THEN CASE WHEN g2 = 1 THEN 1 ELSE 0 END ELSE 0 END AS carried,
         CASE WHEN i = 1 THEN CASE WHEN g2 = 2 THEN 1 ELSE 0 END WHEN i = 2 THEN CASE WHEN g2 = 1 THEN 1 ELSE 0 END ELSE 0 END AS carried2
  FROM alleles)"""


def _stats_sql(table: str, carried: str) -> str:
    def n(kind):
        return f"count(DISTINCT CASE WHEN class = '{kind}' THEN pos END)"

    return f"""SELECT file, count(DISTINCT pos) AS total_records, {n('snp')} AS snps, {n('indel')} AS indels, {n('mnp')} AS mnps,
       {n('other')} AS others, count(*) FILTER (change = 'ts') AS ts, count(*) FILTER (change = 'tv') AS tv,
       count(*) FILTER ({carried} = 1) AS singletons,
       CASE WHEN count(*) FILTER (change = 'tv') > 0
              THEN round(count(*) FILTER (change = 'ts') / count(*) FILTER (change = 'tv'), 9)
            WHEN count(*) FILTER (change = 'ts') > 0 THEN CAST('Infinity' AS DOUBLE) END AS ts_tv_ratio
FROM {table} GROUP BY file"""


def _rounded(df):
    return df.withColumn("ts_tv_ratio", F.round("ts_tv_ratio", 9))


@query(f"WITH {VARIANTS}, {_ALLELES} {_stats_sql('classed', 'carried')}")
def variant_stats(spark, sf):
    return _rounded(vr.variant_stats(views.variants(spark, sf)))


@query(f"WITH {VARIANTS}, {_ALLELES} SELECT file, chrom, pos, alt, class, change FROM classed")
def variant_classes(spark, sf):
    alleles = views.variants(spark, sf).select("file", "chrom", "pos", "ref", F.explode("alts").alias("alt"))
    return alleles.select(
        "file",
        "chrom",
        "pos",
        "alt",
        vf.variant_class(F.col("ref"), F.col("alt")).alias("class"),
        vf.titv_class(F.col("ref"), F.col("alt")).alias("change"),
    )


@query(
    f"""WITH {VARIANTS} SELECT file, chrom, pos, ref FROM variants
WHERE (chrom = 'Brand#3' AND pos <= 1500 AND pos + greatest(length(ref), 1) - 1 >= 100) OR chrom = 'Brand#7'
  OR (chrom = 'Brand#9' AND pos + greatest(length(ref), 1) - 1 >= 700)"""
)
def region_filter(spark, sf):
    out = vr.region_filter(views.variants(spark, sf), "Brand#3:100-1500,Brand#7,Brand#9:700-")
    return out.select("file", "chrom", "pos", "ref")


@query(f"WITH {VARIANTS}, {_ALLELES}, own AS (SELECT * FROM classed WHERE carried2 > 0) {_stats_sql('own', 'carried2')}")
def sample_filter(spark, sf):
    names = F.array(F.lit("S1"), F.lit("S2"))
    return _rounded(vr.variant_stats(vr.sample_filter(views.variants(spark, sf), "S2", names)))


@query(
    """SELECT 'g' AS file, lower(r_name) AS gene, 'chr' || r_regionkey AS contig, CAST(r_regionkey * 100000 + 1 AS BIGINT) AS "start",
       CAST((r_regionkey + 1) * 100000 AS BIGINT) AS "end", 'Gene' || r_regionkey AS gene_id FROM region"""
)
def find_gene(spark, sf):
    names = views.table(spark, sf, "region").select(F.lower("r_name").alias("gene"))
    return genes.find_gene(views.features(spark, sf), names)


@query(
    """SELECT 'g' AS file, 'gene' || n_regionkey AS gene, 'chr' || s_nationkey AS contig, s_suppkey * 10 + 1 AS "start",
       s_suppkey * 10 + 8 AS "end"
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0"""
)
def gene_exons(spark, sf):
    names = views.table(spark, sf, "region").select(F.concat(F.lit("gene"), F.col("r_regionkey").cast("string")).alias("gene"))
    return genes.gene_exons(views.features(spark, sf), names)


@query(
    """SELECT 'chr' || r_regionkey AS contig, CAST(r_regionkey * 100000 AS BIGINT) AS "start",
       CAST((r_regionkey + 1) * 100000 AS BIGINT) AS "end", 'GENE2' AS name, CAST(1 AS BIGINT) AS line_no
FROM region WHERE r_regionkey = 2"""
)
def target_of_gene(spark, sf):
    return target_regions(spark, gene="GENE2", features=views.features(spark, sf), one_based=True)
