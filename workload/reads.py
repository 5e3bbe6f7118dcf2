"""Run logs, length and quality distributions, reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlens.functions import reads as fn
from strandlens.operators import distribution as ds
from strandlens.operators import reads as rd
from strandlens.operators import runs as rn
from strandlens.plans.presets import apply_read_preset
from strandlens.plans.reports import read_length_distribution as length_report
from strandlens.plans.reports import qscore_distribution as qscore_report
from workload import views
from workload.oracle import LENGTHS, READS, RUNS, SCORED
from workload.registry import query


def n50_sql(table: str, length: str = "length") -> str:
    return f"""n50 AS (
  SELECT file, CAST(max({length}) AS BIGINT) AS n50 FROM (
    SELECT file, {length}, sum({length}) OVER (PARTITION BY file ORDER BY {length} DESC RANGE UNBOUNDED PRECEDING) AS cum,
           sum({length}) OVER (PARTITION BY file) AS tot FROM {table})
  WHERE cum >= tot / 2.0 GROUP BY file)"""


def histogram_sql(table: str, value: str, width: float, weight: str = "1") -> str:
    return f"""
binned AS (SELECT file, CAST(floor({value} / {width}) AS BIGINT) AS idx, sum({weight}) AS n FROM {table} GROUP BY ALL),
bins AS (SELECT file, unnest(range(0, max(idx) + 1)) AS idx FROM binned GROUP BY file)
SELECT file, idx * CAST({width} AS DOUBLE) AS "start", (idx + 1) * CAST({width} AS DOUBLE) AS "end",
       CAST(coalesce(n, 0) AS BIGINT) AS "count"
FROM bins LEFT JOIN binned USING (file, idx)"""


def percentiles_sql(value: str) -> str:
    return ", ".join(f"quantile_cont({value}, {p}) AS {name}" for name, p in ds.PERCENTILES.items())


@query(
    f"""WITH {RUNS}, {n50_sql('runs')}
SELECT r.file, CAST(sum(length) AS BIGINT) AS total_yield, count(*) AS total_reads, any_value(n50) AS n50,
       avg(length) AS mean_length, round(avg(qscore), 9) AS mean_qscore, count(DISTINCT channel) AS active_channels,
       (max(start_time) - min(start_time)) / 3600.0 AS run_duration_hours
FROM runs r JOIN n50 USING (file) GROUP BY r.file"""
)
def run_stats(spark, sf):
    return rn.run_stats(views.runs(spark, sf)).withColumn("mean_qscore", F.round("mean_qscore", 9))


@query(
    f"""WITH {RUNS}, h AS (SELECT file, length, start_time / 3600.0 AS h FROM runs),
span AS (SELECT file, min(h) AS lo, max(h) AS hi FROM h GROUP BY file)
SELECT file, lo + CAST(floor(h - lo) AS BIGINT) AS window_start_hours, CAST(sum(length) AS BIGINT) AS yield_bp,
       count(*) AS read_count
FROM h JOIN span USING (file) WHERE hi > lo GROUP BY ALL"""
)
def yield_per_hour(spark, sf):
    return rn.yield_per_hour(views.runs(spark, sf))


@query(f"WITH {RUNS} SELECT file, count(DISTINCT channel) AS active_channels FROM runs GROUP BY file")
def active_channels(spark, sf):
    return rn.active_channels(views.runs(spark, sf))


@query(f"WITH {LENGTHS}, {n50_sql('lengths')} SELECT file, n50 FROM n50")
def n50(spark, sf):
    return ds.n50(views.lengths(spark, sf))


@query(f"WITH {LENGTHS} SELECT file, count(*) AS read_count, {percentiles_sql('length')} FROM lengths GROUP BY file")
def length_percentiles(spark, sf):
    return ds.length_percentiles(views.lengths(spark, sf))


@query(f"WITH {LENGTHS}, {histogram_sql('lengths', 'length', 2000)}")
def length_histogram(spark, sf):
    return ds.length_histogram(views.lengths(spark, sf))


@query(f"WITH {RUNS}, {histogram_sql('runs', 'qscore', 1.0)}")
def qscore_histogram(spark, sf):
    return ds.qscore_histogram(views.runs(spark, sf))


@query(
    f"""WITH {SCORED}
SELECT file, read_id, len AS length, gc, gc / nullif(len, 0) AS gc_content, round(q, 6) AS mean_qscore FROM scored"""
)
def read_scalars(spark, sf):
    return views.reads(spark, sf).select(
        "file",
        "read_id",
        fn.read_length(F.col("seq")).alias("length"),
        fn.gc_count(F.col("seq")).alias("gc"),
        fn.gc_content(F.col("seq")).alias("gc_content"),
        F.round(fn.mean_qscore(F.col("qual")), 6).alias("mean_qscore"),
    )


@query(
    f"""WITH {SCORED}, {n50_sql('scored', 'len')}
SELECT s.file, count(*) AS read_count, CAST(sum(len) AS BIGINT) AS total_bases, min(len) AS min_len, max(len) AS max_len,
       avg(len) AS mean_len, median(len) AS median_len, any_value(n50) AS n50, round(avg(q), 6) AS mean_qscore,
       round(median(q), 6) AS median_qscore, sum(gc) / sum(len) AS gc_content, {percentiles_sql('len')}
FROM scored s JOIN n50 USING (file) GROUP BY s.file"""
)
def read_stats(spark, sf):
    out = rd.read_stats(views.reads(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_qscore", "median_qscore")})


def _unnested(report, name):
    return report.select("file", F.inline(name))


@query(f"WITH {READS}, r AS (SELECT file, length(seq) AS len FROM reads), {histogram_sql('r', 'len', 2000)}")
def read_length_distribution(spark, sf):
    return _unnested(length_report(views.reads(spark, sf)), "histogram")


@query(f"WITH {SCORED}, {histogram_sql('scored', 'q', 1.0)}")
def qscore_distribution(spark, sf):
    return _unnested(qscore_report(views.reads(spark, sf)), "histogram")


@query(f"WITH {SCORED} SELECT file, round(avg(q), 6) AS mean_qscore, round(median(q), 6) AS median_qscore FROM scored GROUP BY file")
def qscore_stats(spark, sf):
    out = rd.qscore_stats(views.reads(spark, sf))
    return out.select("file", *[F.round(c, 6).alias(c) for c in ("mean_qscore", "median_qscore")])


@query(
    f"""WITH {READS}, b AS (
  SELECT file, unnest(range(1, length(qual) + 1)) AS cycle, unnest(string_split(qual, '')) AS c FROM reads WHERE qual <> '')
SELECT file, cycle, count(*) AS reads, round(avg(ascii(c) - 33), 6) AS mean_q FROM b GROUP BY ALL"""
)
def per_position_quality(spark, sf):
    return rd.per_position_quality(views.reads(spark, sf)).withColumn("mean_q", F.round("mean_q", 6))


@query(f"WITH {SCORED} SELECT file, read_id FROM scored WHERE len >= 500 AND len <= 20000 AND q >= 16.5 AND q <= 17")
def filter_reads(spark, sf):
    kept = rd.filter_reads(views.reads(spark, sf), min_len=500, max_len=20000, min_qual=16.5, max_qual=17)
    return kept.select("file", "read_id")


@query(f"WITH {SCORED} SELECT file, count(*) AS reads FROM scored WHERE len >= 1000 AND q >= 10 GROUP BY file")
def strict_qc(spark, sf):
    return apply_read_preset(views.reads(spark, sf), "strict_qc").groupBy("file").agg(F.count("*").alias("reads"))


@query(f"WITH {SCORED} SELECT file, count(*) AS reads FROM scored WHERE len >= 200 AND q >= 7 GROUP BY file")
def lenient_qc(spark, sf):
    return apply_read_preset(views.reads(spark, sf), "lenient_qc").groupBy("file").agg(F.count("*").alias("reads"))


@query(
    f"""WITH {READS}
SELECT file, read_id, md5(substr(seq, 51, length(seq) - 100)) AS seq, md5(substr(qual, 51, length(qual) - 100)) AS qual
FROM reads WHERE length(seq) - 100 >= 500"""
)
def aggressive_trim(spark, sf):
    kept = apply_read_preset(views.reads(spark, sf), "aggressive_trim")
    return kept.select("file", "read_id", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


# where the first and last base of quality 22 or more are, by regular expression
_SPAN = """cut AS (
  SELECT file, read_id, seq, qual, q, length(regexp_extract(qual, '^[^7-~]*')) AS head,
         length(regexp_extract(qual, '[^7-~]*$')) AS tail FROM scored)"""


@query(
    f"""WITH {SCORED}, {_SPAN}
SELECT file, read_id, md5(substr(seq, head + 1, length(seq) - head - tail)) AS seq,
       md5(substr(qual, head + 1, length(qual) - head - tail)) AS qual
FROM cut WHERE q >= 16.6 AND length(seq) - head - tail >= 1"""
)
def trim_by_quality(spark, sf):
    kept = rd.filter_trim(views.reads(spark, sf), quality=16.6, cutoff=22, trim_approach="trim-by-quality")
    return kept.select("file", "read_id", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


@query(
    f"""WITH {SCORED} SELECT file, read_id, len AS length FROM scored WHERE len < 1000"""
)
def inverse_short_reads(spark, sf):
    kept = apply_read_preset(views.reads(spark, sf), "inverse_short_reads")
    return kept.select("file", "read_id", fn.read_length(F.col("seq")).alias("length"))


@query(
    f"""WITH {SCORED}, f AS (SELECT file, q >= 16.5 AND len - 30 >= 200 AND len - 30 <= 30000 AS ok FROM scored)
SELECT file, count(*) AS input_reads, count(*) FILTER (ok) AS output_reads,
       count(*) - count(*) FILTER (ok) AS filtered_reads FROM f GROUP BY file"""
)
def filter_report(spark, sf):
    return rd.filter_report(
        views.reads(spark, sf), headcrop=10, tailcrop=20, minlength=200, maxlength=30000, quality=16.5
    )
