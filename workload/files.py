"""Readers and writers: tables are written as files of each format and read back.

The SQL side starts from the tables, so it never sees the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlens.operators import genes
from strandlens.operators import headers as hd
from strandlens.operators import intervals as iv
from strandlens.operators import runs as rn
from strandlens.operators import variants as vr
from strandlens.operators.overlap import attach_region_names, attach_thresholds
from strandlens.plans.reports import run_report
from strandlens.session import scratch_dir
from strandlens.sources import fastq, headers, intervals, manifest, reports, runlog, sam, sinks, vcf
from workload import views
from workload.alignments import _NAMES
from workload.annotations import _ALLELES, BED, _rounded, _stats_sql
from workload.oracle import ALN, READS, REGIONS, RUNS, VARIANTS
from workload.reads import n50_sql
from workload.registry import query


def write_lines(df: DataFrame, label: str, *parts: str) -> str:
    """Writes ``value`` as text below a new scratch folder, one sub-folder per value of ``parts``."""
    path = scratch_dir(df.sparkSession, label)
    writer = df.select(*parts, "value").write
    (writer.partitionBy(*parts) if parts else writer).text(path)
    return path


def write_ordered(df: DataFrame, label: str, *parts: str) -> str:
    """As ``write_lines``, with one file per value of ``parts`` and its lines in order of ``ord``."""
    path = scratch_dir(df.sparkSession, label)
    one_each = df.repartition(*parts).sortWithinPartitions(*parts, "ord")
    one_each.select(*parts, "value").write.partitionBy(*parts).text(path)
    return path


def src(name: str = "src") -> Column:
    """The label a file was written under; escaped once in the folder name and once in the path."""
    return F.url_decode(F.url_decode(F.regexp_extract("file", rf"/{name}=([^/]+)", 1)))


def lines(value: str) -> Column:
    """Tab-separated line from comma-separated SQL expressions."""
    return F.expr(f"concat_ws('\\t', {value})").alias("value")


@query(f"WITH {READS} SELECT file || '|' || read_id AS read_id, md5(seq) AS seq, md5(qual) AS qual FROM reads")
def fastq_round_trip(spark, sf):
    path = scratch_dir(spark, "fastq")
    reads = views.reads(spark, sf)
    sinks.write_fastq(reads.withColumn("read_id", F.concat_ws("|", "file", "read_id")), path, compression="gzip")
    return fastq.read_fastq(spark, path, check_names=False).select("read_id", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


@query(f"WITH {READS} SELECT file || '|' || read_id AS read_id, md5(seq) AS seq, md5(qual) AS qual FROM reads")
def bgz_fastq_round_trip(spark, sf):
    """Block-gzip files, each read by as many tasks as it has splits."""
    path = scratch_dir(spark, "fastq")
    reads = views.reads(spark, sf)
    sinks.write_fastq(reads.withColumn("read_id", F.concat_ws("|", "file", "read_id")), path, compression="bgz")
    back = fastq.read_fastq(spark, path, check_names=False, blocks=True)
    return back.select("read_id", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


@query(
    f"""WITH {READS}, every AS (
  SELECT file, count(*) AS input_reads, count(*) FILTER (length(seq) >= 230) AS output_reads, count(*) FILTER (length(seq) < 230) AS filtered_reads,
         CAST(coalesce(sum(length(seq) - 30) FILTER (length(seq) >= 230), 0) AS BIGINT) AS output_bases FROM reads GROUP BY file)
SELECT *, output_reads AS written_reads, output_bases AS written_bases FROM every"""
)
def filter_to_fastq(spark, sf):
    """Counts of the pass that wrote the reads, beside those of the files."""
    reads = views.reads(spark, sf)
    names = [r.file for r in reads.select("file").distinct().orderBy("file").collect()]
    path = scratch_dir(spark, "filtered")
    labelled = reads.withColumn("read_id", F.concat_ws("|", "file", "read_id"))
    counts = sinks.filter_to_fastq(labelled, path, names, compression="bgz", headcrop=10, tailcrop=20, minlength=200)
    back = fastq.read_fastq(spark, path, check_names=False, blocks=True)
    found = back.groupBy(F.substring_index("read_id", "|", 1).alias("file")).agg(
        F.count("*").alias("written_reads"), F.sum(F.length("seq")).cast("bigint").alias("written_bases")
    )
    both = counts.where("file IS NOT NULL").join(found, "file", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("written_reads", "written_bases")})


@query(
    f"""WITH {READS} SELECT file AS src, 'ok' AS status,
  CAST(sum(length(read_id) + 2 * length(seq) + 6) AS BIGINT) AS length FROM reads GROUP BY file"""
)
def file_manifest(spark, sf):
    record = F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id")), "seq", F.lit("+"), "qual").alias("value")
    path = write_lines(views.reads(spark, sf).select(F.col("file").alias("src"), record), "manifest", "src")
    found = manifest.file_manifest(spark, f"{path}/*/*.txt", max_bytes=1 << 40)
    return found.groupBy(src().alias("src"), "status").agg(F.sum("length").alias("length"))


@query(
    f"""WITH {ALN}
SELECT file, qname, flag, contig, pos, CAST(mapq AS INTEGER) AS mapq, cigar, tlen, md5(seq) AS seq, md5(qual) AS qual,
       CAST(nm AS VARCHAR) AS nm, CASE WHEN k = 1 THEN CAST(l_discount AS VARCHAR) END AS de
FROM aln"""
)
def sam_round_trip(spark, sf):
    body = views.alignments(spark, sf).select(
        F.col("file").alias("src"),
        lines(
            """qname, flag, contig, pos + 1, mapq, cigar, rnext, pnext + 1, tlen, seq, qual, concat('NM:i:', tags['NM']),
               concat('MD:Z:', tags['MD']), concat('de:f:', tags['de'])"""
        ),
    )
    aln = sam.read_sam(spark, write_lines(body, "sam", "src"), check_names=False)
    return aln.select(
        src().alias("file"), "qname", "flag", "contig", "pos", "mapq", "cigar", "tlen",
        F.md5("seq").alias("seq"), F.md5("qual").alias("qual"),
        F.col("tags")["NM"].alias("nm"), F.col("tags")["de"].alias("de"),
    )


_VCF_LINE = """chrom, pos, id, ref, array_join(alts, ','), qual, filter, concat('DP=', info['DP'], ';DB'),
  array_join(format, ':'), array_join(samples, '\\t')"""


@query(f"WITH {VARIANTS}, {_ALLELES} {_stats_sql('classed', 'carried')}")
def vcf_round_trip(spark, sf):
    body = views.variants(spark, sf).select(F.col("file").alias("src"), lines(_VCF_LINE))
    variants = vcf.read_vcf(spark, write_lines(body, "vcf", "src"), check_names=False)
    return _rounded(vr.variant_stats(variants.withColumn("file", src())))


@query(f"WITH {VARIANTS}, {_ALLELES} {_stats_sql('classed', 'carried')}")
def bgz_vcf_round_trip(spark, sf):
    """The same from block-gzip files; the input is the INFO field ``SRC``."""
    path = scratch_dir(spark, "vcf")
    named = views.variants(spark, sf).withColumn("info", F.map_concat("info", F.create_map(F.lit("SRC"), F.col("file"))))
    sinks.write_text(named.select(lines(_VCF_LINE.replace(";DB", ";DB;SRC=', info['SRC'], '"))), path, compression="bgz")
    variants = vcf.read_vcf(spark, path, check_names=False, blocks=True)
    return _rounded(vr.variant_stats(variants.withColumn("file", F.col("info")["SRC"])))


@query(
    f"""WITH {BED}
SELECT file, count(*) AS total_intervals, count(*) FILTER (kind IN ('ok', 'ok20')) AS valid_intervals,
       CAST(coalesce(sum(CASE kind WHEN 'ok' THEN size WHEN 'ok20' THEN 20 - size END), 0) AS BIGINT) AS total_bases,
       count(*) FILTER (kind NOT IN ('ok', 'ok20')) = 0 AS is_valid
FROM bed GROUP BY file"""
)
def bed_round_trip(spark, sf):
    path = write_lines(views.bed_lines(spark, sf).withColumnRenamed("file", "src"), "bed", "src")
    return iv.bed_qc(intervals.read_bed_lines(spark, path, check_names=False).withColumn("file", src()))


@query(
    f"""WITH {REGIONS} SELECT contig, s AS "start", e AS "end", coalesce(name, '') AS name FROM regions"""
)
def write_bed_round_trip(spark, sf):
    path = scratch_dir(spark, "regions")
    sinks.write_bed(views.regions(spark, sf), path)
    back = intervals.read_bed_regions(spark, path, check_names=False)
    return back.select("contig", "start", "end", F.coalesce("name", F.lit("")).alias("name"))


@query(
    """SELECT 'gene' || n_regionkey AS gene, 'chr' || s_nationkey AS contig, s_suppkey * 10 + 1 AS "start", s_suppkey * 10 + 8 AS "end"
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0"""
)
def gff3_round_trip(spark, sf):
    text = views.features(spark, sf).select(
        lines(
            """seqid, '.', type, start, end, '.', '+', '.',
               array_join(transform(map_entries(attrs), e -> concat(upper(substr(e.key, 1, 1)), substr(e.key, 2), '=', e.value)), ';')"""
        )
    )
    features = intervals.read_gff3(spark, write_lines(text, "gff3"), check_names=False)
    names = views.table(spark, sf, "region").select(F.concat(F.lit("gene"), F.col("r_regionkey").cast("string")).alias("gene"))
    return genes.gene_exons(features, names, by=())


def _run_logs(spark, sf) -> DataFrame:
    """Run logs read back from files of two layouts, several files per label."""
    runs = views.runs(spark, sf)
    parts = spark.sparkContext.defaultParallelism
    rows = runs.select(
        F.col("file").alias("src"), F.pmod(F.col("event_id"), F.lit(parts)).alias("part"), F.lit(1).alias("ord"),
        F.expr(
            """CASE WHEN pmod(event_id, 2) = 0 THEN concat_ws('\\t', 'f', event_id, channel, start_time, length, qscore)
               ELSE concat_ws('\\t', length, qscore, 7, start_time, channel) END"""
        ).alias("value"),
    )
    if parts % 2:  # one layout per file
        rows = rows.withColumn("part", F.col("part") * 2 + F.when(F.startswith("value", F.lit("f\t")), 0).otherwise(1))
    even = "filename\tread_id\tchannel\tstart_time\tsequence_length_template\tmean_qscore_template"
    odd = "Read_Length\tread_quality\ttemplate_duration_time\tstart_time_utc\tchannel_id"
    heads = rows.select("src", "part").distinct().select(
        "src", "part", F.lit(0).alias("ord"), F.when(F.col("part") % 2 == 0, even).otherwise(odd).alias("value")
    )
    path = write_ordered(rows.unionByName(heads), "runs", "src", "part")
    return runlog.read_sequencing_summary(spark, path, check_names=False).withColumn("file", src())


@query(
    f"""WITH {RUNS}, {n50_sql('runs')}
SELECT r.file, CAST(sum(length) AS BIGINT) AS total_yield, count(*) AS total_reads, any_value(n50) AS n50,
       avg(length) AS mean_length, round(avg(qscore), 9) AS mean_qscore, count(DISTINCT channel) AS active_channels,
       (max(start_time) - min(start_time)) / 3600.0 AS run_duration_hours
FROM runs r JOIN n50 USING (file) GROUP BY r.file"""
)
def run_log_round_trip(spark, sf):
    return rn.run_stats(_run_logs(spark, sf)).withColumn("mean_qscore", F.round("mean_qscore", 9))


@query(
    f"""WITH {RUNS}, h AS (SELECT file, length, start_time / 3600.0 AS h FROM runs),
span AS (SELECT file, min(h) AS lo FROM h GROUP BY file),
w AS (SELECT file, floor(h - lo) AS k, sum(length) AS bp FROM h JOIN span USING (file) GROUP BY ALL)
SELECT file, CAST(sum(bp) AS BIGINT) AS total_yield, count(*) AS windows, CAST(max(bp) AS BIGINT) AS best FROM w GROUP BY file"""
)
def report_round_trip(spark, sf):
    path = scratch_dir(spark, "report")
    report = run_report(views.runs(spark, sf))
    sinks.write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    best = F.array_max(F.transform("yield_per_hour", lambda w: w["yield_bp"]))
    return back.select("file", "total_yield", F.size("yield_per_hour").cast("bigint").alias("windows"), best.alias("best"))


# ---- headers: one file per region, its nations as contigs and its suppliers as read groups


def _sam_headers(spark, sf) -> DataFrame:
    nation, supplier = views.table(spark, sf, "nation"), views.table(spark, sf, "supplier")
    region = views.table(spark, sf, "region")
    head = region.selectExpr(
        "r_regionkey src", "-1L ord", "concat_ws('\\t', '@HD', 'VN:1.6', 'SO:coordinate', concat('XX:', r_name)) value"
    )
    contigs = nation.selectExpr(
        "n_regionkey src",
        "cast(n_nationkey as bigint) ord",
        """concat_ws('\\t', '@SQ', concat('SN:', n_name),
             concat('LN:', CASE WHEN n_nationkey % 7 = 0 THEN 'x' ELSE cast(1000 + n_nationkey as string) END),
             CASE WHEN n_nationkey % 2 = 0 THEN concat('AS:a', n_nationkey) END, concat('SP:', n_regionkey)) value""",
    )
    groups = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "n_regionkey src",
        "1000 + s_suppkey ord",
        """concat_ws('\\t', '@RG', concat('ID:', s_suppkey), CASE WHEN s_suppkey % 3 > 0 THEN concat('SM:', s_name) END,
             'PL:ONT', 'badtag', concat('DT:2024-01-01T', s_nationkey, ':00')) value""",
    )
    tail = region.selectExpr(
        "r_regionkey src", "2000000000000 ord",
        "concat('@PG\\tPN:tool', r_regionkey, '\\tCL:run -a x:y\\n@PG\\tID:second\\tPN:tool2\\tPP:first\\tZZ:z\\n@CO\\tfree\\ttext') value",
    )
    path = write_ordered(head.union(contigs).union(groups).union(tail), "samhead", "src")
    return headers.sam_header_lines(spark, path)


@query(
    """SELECT CAST(n_regionkey AS VARCHAR) AS src, n_name AS name, CASE WHEN n_nationkey % 7 > 0 THEN CAST(1000 + n_nationkey AS BIGINT) END AS length,
       CASE WHEN n_nationkey % 2 = 0 THEN 'a' || n_nationkey END AS assembly, CAST(n_regionkey AS VARCHAR) AS species FROM nation"""
)
def sam_header_references(spark, sf):
    refs = headers.sam_references(_sam_headers(spark, sf))
    return refs.select(src().alias("src"), "name", "length", "assembly", F.col("other")["SP"].alias("species"))


@query(
    """SELECT CAST(n_regionkey AS VARCHAR) AS src, CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END AS name,
       CAST(s_suppkey AS VARCHAR) AS read_group_id, 'ONT' AS platform, '2024-01-01T' || s_nationkey || ':00' AS run_date
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def sam_header_samples(spark, sf):
    samples = headers.sam_samples(_sam_headers(spark, sf))
    return samples.select(src().alias("src"), "name", "read_group_id", "platform", "run_date")


@query(
    """SELECT CAST(r_regionkey AS VARCHAR) AS src, id, 'tool' || n AS name, previous_id
FROM (SELECT r_regionkey, 'tool' || r_regionkey AS id, CAST(r_regionkey AS VARCHAR) AS n, NULL AS previous_id FROM region
      UNION ALL SELECT r_regionkey, 'second', '2', 'first' FROM region)"""
)
def sam_header_programs(spark, sf):
    return headers.sam_programs(_sam_headers(spark, sf)).select(src().alias("src"), "id", "name", "previous_id")


def _first_names(n: str, order: str, size: str) -> str:
    return f"array_to_string((list({n} ORDER BY {order}))[1:3], ', ') || CASE WHEN {size} > 3 THEN ', …' ELSE '' END"


@query(
    f"""WITH c AS (SELECT n_regionkey AS r, count(*) AS n, {_first_names('n_name', 'n_nationkey', 'count(*)')} AS names FROM nation GROUP BY n_regionkey),
s AS (SELECT n_regionkey AS r, {_first_names("CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END", 's_suppkey', 'count(*)')} AS names
      FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey)
SELECT CAST(r_regionkey AS VARCHAR) AS src,
       'SAM header; ' || c.n || ' contigs (e.g., ' || c.names || '); samples: ' || s.names || '; programs: tool' || r_regionkey
         || ', tool2; sort order=coordinate; extras h=1,sq=' || c.n || ',pg=1,rg=0,vcf=0' AS summary,
       r_name AS extra, 'free' || chr(9) || 'text' AS comment
FROM region JOIN c ON c.r = r_regionkey JOIN s ON s.r = r_regionkey"""
)
def sam_header_catalog(spark, sf):
    catalog = hd.alignment_header_catalog(_sam_headers(spark, sf))
    return catalog.select(
        src().alias("src"), "summary", F.col("header_other")["XX"].alias("extra"), F.col("comments")[0].alias("comment")
    )


def _vcf_headers(spark, sf) -> DataFrame:
    nation, region = views.table(spark, sf, "nation"), views.table(spark, sf, "region")
    parts = [
        region.selectExpr(
            "r_regionkey src", "-1L ord",
            """concat('##fileformat=VCFv4.3\\n##source=', r_name, '=x \\n#plain remark\\n##FILTER=<ID=q10,Description="Low, very">') value""",
        ),
        nation.selectExpr(
            "n_regionkey src", "cast(n_nationkey as bigint) ord",
            """concat('##contig=<ID=', n_name, ',length=', 5000 + n_nationkey, ',IDX=', n_nationkey, '>\\n##INFO=<ID=I', n_nationkey,
               ',Number=1,Type=Integer,Description="Depth, of \\\\"all\\\\"",Source="caller">') value""",
        ),
        region.selectExpr(
            "r_regionkey src", "1000L ord",
            """concat('##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">\\n#CHROM\\tPOS\\tID\\tREF\\tALT\\tQUAL\\tFILTER\\tINFO\\tFORMAT\\t',
               r_name, '\\ts2\\nchr1\\t1\\t.\\tA\\tG\\t30\\tPASS\\t.\\tGT\\t0/1\\t0/0\\n##late=ignored') value""",
        ),
    ]
    path = write_ordered(parts[0].union(parts[1]).union(parts[2]), "vcfhead", "src")
    return headers.require_header(headers.vcf_header_lines(spark, path), path)


@query(
    """SELECT CAST(n_regionkey AS VARCHAR) AS src, 'INFO' AS category, 'I' || n_nationkey AS id, '1' AS number, 'Integer' AS type,
       'Depth, of \\"all\\' AS description, 'caller' AS origin FROM nation
UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 'FORMAT', 'GT', '1', 'String', 'Genotype', NULL FROM region
UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 'FILTER', 'q10', NULL, NULL, 'Low, very', NULL FROM region"""
)
def vcf_header_fields(spark, sf):
    fields = headers.vcf_fields(_vcf_headers(spark, sf))
    return fields.select(
        src().alias("src"), "category", "id", "number", "type", "description", F.col("other")["Source"].alias("origin")
    )


@query(
    """SELECT CAST(n_regionkey AS VARCHAR) AS src, n_name AS name, CAST(5000 + n_nationkey AS BIGINT) AS length,
       CAST(n_nationkey AS VARCHAR) AS idx FROM nation"""
)
def vcf_header_references(spark, sf):
    refs = headers.vcf_references(_vcf_headers(spark, sf))
    return refs.select(src().alias("src"), "name", "length", F.col("other")["IDX"].alias("idx"))


@query(
    f"""WITH c AS (SELECT n_regionkey AS r, count(*) AS n, {_first_names('n_name', 'n_nationkey', 'count(*)')} AS names FROM nation GROUP BY n_regionkey)
SELECT CAST(r_regionkey AS VARCHAR) AS src, r_name || '=x' AS source, '#plain remark' AS comment,
       'VCF header; ' || c.n || ' contigs (e.g., ' || c.names || '); samples: ' || r_name || ', s2; ' || c.n
       || ' INFO fields; 1 FORMAT fields; extras h=0,sq=' || c.n || ',pg=0,rg=0,vcf=' || c.n AS summary
FROM region JOIN c ON c.r = r_regionkey"""
)
def vcf_header_catalog(spark, sf):
    catalog = hd.vcf_header_catalog(_vcf_headers(spark, sf))
    return catalog.select(
        src().alias("src"), F.col("metadata")["source"].alias("source"), F.col("comments")[0].alias("comment"), "summary"
    )


# ---- reports of other programs


def _documents_by(spark, sf) -> DataFrame:
    docs = views.table(spark, sf, "documents")
    return docs.groupBy(F.concat_ws("_", "source", "lang").alias("src")).agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("bases"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi")
    )


_DOCS = """d AS (SELECT source || '_' || lang AS src, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bases, min(n_chars) AS lo, max(n_chars) AS hi
  FROM documents GROUP BY ALL)"""


@query(
    f"""WITH {_DOCS}
SELECT src, n AS read_count, bases AS total_bases, lo AS min_len, hi AS max_len, bases / n AS mean_len,
       CASE WHEN n % 2 = 0 THEN CAST(12.5 AS DOUBLE) END AS mean_qscore, CASE WHEN n % 2 = 1 THEN CAST(0.4 AS DOUBLE) END AS gc_content,
       CASE WHEN n % 2 = 1 THEN CAST(lo AS DOUBLE) END AS p50, CASE WHEN n % 2 = 1 THEN n END AS bin_count
FROM d"""
)
def read_report_ingest(spark, sf):
    """Every other report in the flat layout."""
    flat = F.to_json(
        F.struct(
            F.col("n").alias("reads"), "bases", F.col("lo").alias("shortest"), F.col("hi").alias("longest"),
            (F.col("bases") / F.col("n")).alias("mean_length"), F.lit(12.5).alias("mean_quality"),
        )
    )
    length = F.struct(
        F.col("lo").alias("min"), F.col("hi").alias("max"), (F.col("bases") / F.col("n")).alias("mean"),
        F.struct(F.col("lo").alias("p50")).alias("percentiles"),
        F.array(F.array(F.lit(0), F.lit(10), F.col("n"))).alias("hist"),
    )
    reads = F.struct(F.col("n").alias("count"), "bases", F.lit(0.4).alias("gc"), length.alias("length"))
    nested = F.to_json(F.struct(F.struct(reads.alias("reads")).alias("summary")))
    text = _documents_by(spark, sf).select("src", F.when(F.col("n") % 2 == 0, flat).otherwise(nested).alias("value"))
    out = reports.ingest_read_reports(spark, write_lines(text, "readjson", "src"))
    return out.select(
        src().alias("src"), "read_count", "total_bases", "min_len", "max_len", "mean_len", "mean_qscore", "gc_content",
        F.col("length_percentiles.p50").alias("p50"), F.get("length_histogram", F.lit(0))["count"].alias("bin_count"),
    )


@query(
    f"""WITH {_DOCS}
SELECT src, n AS total_reads, CASE WHEN n % 2 = 1 THEN n - 1 END AS mapped, bases / n AS mean_length, CAST(hi AS BIGINT) AS n50,
       CAST(CASE WHEN n % 2 = 0 THEN 88.5 ELSE 0.95 END AS DOUBLE) AS median_identity, CASE WHEN n % 2 = 1 THEN bases END AS scaled
FROM d"""
)
def alignment_report_ingest(spark, sf):
    """Every other report in the new layout."""
    mean = (F.col("bases") / F.col("n")).alias("mean_length")
    new = F.to_json(
        F.struct(
            F.struct(F.col("n").alias("num_alignments"), F.lit(0).alias("num_reads")).alias("alignment_stats"),
            F.struct(F.col("hi").alias("n50"), mean).alias("read_stats"),
            F.struct(F.lit(88.5).alias("median_identity")).alias("identity_stats"),
        )
    )
    old = F.to_json(
        F.struct(
            F.struct(
                F.struct(F.col("n").alias("total"), (F.col("n") - 1).alias("mapped")).alias("reads"),
                mean,
                F.col("hi").alias("n50"),
                F.lit(0.95).alias("median_identity"),
                F.array(F.array(F.lit(0), F.lit(10), F.col("bases"))).alias("mapq_hist_scaled"),
            ).alias("summary")
        )
    )
    text = _documents_by(spark, sf).select("src", F.when(F.col("n") % 2 == 0, new).otherwise(old).alias("value"))
    out = reports.ingest_alignment_reports(spark, write_lines(text, "alnjson", "src"))
    return out.select(
        src().alias("src"), "total_reads", "mapped", "mean_length", "n50", "median_identity",
        F.get("mapq_histogram_scaled", F.lit(0))["count"].alias("scaled"),
    )


@query(
    """SELECT p_brand AS src, CAST(p_partkey AS DOUBLE) AS "start", CAST(p_partkey + p_size AS DOUBLE) AS "end", CAST(p_size AS BIGINT) AS "count"
FROM part WHERE p_size % 5 > 0"""
)
def histogram_tsv_ingest(spark, sf):
    text = views.table(spark, sf, "part").select(
        F.col("p_brand").alias("src"),
        lines("p_partkey, p_partkey + p_size, CASE WHEN p_size % 5 = 0 THEN 'none' ELSE cast(p_size as string) END"),
    )
    out = reports.ingest_histogram_tsv(spark, write_lines(text, "hist", "src"))
    return out.select(src().alias("src"), "start", "end", "count")


@query(
    """SELECT o_orderpriority AS src, o_orderstatus AS contig, count(*) AS length, CAST(count(*) * 3 AS DOUBLE) AS bases,
       CAST(count(*) % 17 AS DOUBLE) AS mean_depth FROM orders GROUP BY ALL"""
)
def coverage_summary_ingest(spark, sf):
    rows = views.table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    text = rows.select(F.col("o_orderpriority").alias("src"), lines("o_orderstatus, n, n * 3, n % 17"))
    heads = rows.select(F.col("o_orderpriority").alias("src"), F.lit("chrom\tlength\tbases\tmean").alias("value")).distinct()
    out = reports.ingest_coverage_summary(spark, write_lines(text.union(heads), "covsum", "src"))
    return out.select(src().alias("src"), "contig", "length", "bases", "mean_depth")


@query(
    f"""WITH {REGIONS}, {_NAMES}
SELECT contig, s AS "start", e AS "end", CAST(line_no % 91 AS DOUBLE) AS mean_depth, region_name, line_no
FROM (SELECT *, s AS "start", e AS "end" FROM regions) JOIN names USING (contig, "start", "end")"""
)
def region_depth_ingest(spark, sf):
    """Depth rows with and without a name column, named again from the intervals."""
    regions = views.regions(spark, sf)
    text = regions.select(lines("contig, start, end, CASE WHEN line_no % 2 = 0 THEN concat('r', line_no) END, line_no % 91"))
    back = reports.ingest_region_depth(spark, write_lines(text, "regiondepth"))
    # equal rows may lie in several files
    named = attach_region_names(back.drop("file"), regions)
    lines_of = regions.select("contig", "start", "end", "line_no", (F.col("line_no") % 91).cast("double").alias("mean_depth"))
    return named.distinct().join(lines_of, ["contig", "start", "end", "mean_depth"]).select(
        "contig", "start", "end", "mean_depth", "region_name", "line_no"
    )


@query(
    f"""WITH {REGIONS}, t AS (SELECT contig, s, e, max(line_no) AS k FROM regions GROUP BY ALL)
SELECT contig, s AS "start", e AS "end", 100.0 * (k % 11) / 10 AS pct_coverage_1x, 100.0 * (k % 6) / 10 AS pct_coverage_10x FROM t"""
)
def region_thresholds_ingest(spark, sf):
    rows = views.regions(spark, sf).groupBy("contig", "start", "end").agg(F.max("line_no").alias("k"))
    text = rows.select(lines("contig, start, end, CASE WHEN k % 2 = 0 THEN 'name' END, (k % 11) / 10, (k % 6) / 10"))
    back = reports.ingest_region_thresholds(spark, write_lines(text, "thresholds"), (1, 10))
    return back.drop("file")


@query(
    """SELECT l_returnflag AS src, 'COV' AS section, CAST(l_quantity AS DOUBLE) AS key_num, CAST(count(*) AS VARCHAR) AS value
FROM lineitem GROUP BY ALL
UNION ALL SELECT l_returnflag, 'IS', CAST(l_linenumber AS DOUBLE), CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY ALL
UNION ALL SELECT l_returnflag, 'GCD', CAST(l_suppkey % 5 AS DOUBLE) + 0.5, CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY ALL"""
)
def stats_sections_ingest(spark, sf):
    out = reports.ingest_stats_sections(spark, _stats_text(spark, sf))
    return out.where(F.col("section").isin("COV", "IS", "GCD")).select(src().alias("src"), "section", "key_num", "value")


@query(
    f"""WITH {REGIONS}, {_NAMES}
SELECT contig, "start", "end", region_name, CAST(max(line_no) % 91 + 0.5 AS DOUBLE) AS mean_depth,
       CASE WHEN max(line_no) % 3 > 0 THEN CAST(100.0 * (max(line_no) % 11) / 10 AS DOUBLE) END AS pct_coverage_1x
FROM (SELECT *, s AS "start", e AS "end" FROM regions) JOIN names USING (contig, "start", "end") GROUP BY ALL"""
)
def target_report_ingest(spark, sf):
    """Depth and threshold files of the same regions put together; some regions have no thresholds."""
    regions = views.regions(spark, sf)
    rows = regions.groupBy("contig", "start", "end").agg(F.max("line_no").alias("k"))
    depth = reports.ingest_region_depth(spark, write_lines(rows.select(lines("contig, start, end, k % 91 + 0.5")), "tdepth"))
    shares = rows.where("k % 3 > 0").select(lines("contig, start, end, (k % 11) / 10"))
    found = reports.ingest_region_thresholds(spark, write_lines(shares, "tshares"), (1,)).drop("file")
    return attach_thresholds(attach_region_names(depth, regions), found).drop("file")


def _stats_text(spark, sf) -> str:
    items = views.table(spark, sf, "lineitem").withColumn("src", F.col("l_returnflag"))

    def counted(key: str, value: str) -> DataFrame:
        return items.groupBy("src", F.expr(key).alias("k")).agg(F.count("*").alias("n")).select("src", lines(value))

    parts = [
        counted("cast(l_quantity as int)", "'COV', CASE WHEN k % 2 = 0 THEN concat('[', k, '-', k, ']') END, k, n"),
        counted("l_linenumber", "'IS', k, n, 0"),
        counted("l_suppkey % 5", "'GCD', k + 0.5, 'x', n"),
        counted("0", "'SN', 'insertions per base:', n / 1e9, '# remark'"),
        counted("0", "'SN', 'error rate:', n / 1e8"),
        counted("0", "'GCD', 'bad', 'x', 'y'"),
    ]
    text = parts[0]
    for part in parts[1:]:
        text = text.unionByName(part)
    # one file per label: sections of one report belong together
    return write_ordered(text.withColumn("ord", F.lit(0)), "stats", "src")


@query(
    """SELECT l_returnflag AS src, count(*) / 1e8 AS mismatch_rate, count(*) / 1e9 AS insertion_rate, CAST(NULL AS DOUBLE) AS deletion_rate
FROM lineitem GROUP BY l_returnflag"""
)
def stats_error_rates(spark, sf):
    out = reports.error_rates_of_sections(reports.ingest_stats_sections(spark, _stats_text(spark, sf)))
    return out.select(src().alias("src"), "mismatch_rate", "insertion_rate", "deletion_rate")


@query(
    """SELECT p_brand AS src, count(*) AS total_records, count(*) FILTER (p_size % 2 = 0) AS snps,
       count(*) FILTER (p_size % 2 = 1) AS indels, CAST(0 AS BIGINT) AS mnps, CAST(NULL AS BIGINT) AS singletons, 'S_' || p_brand AS sample_name,
       CASE WHEN count(*) FILTER (p_size % 3 = 0) = 0 THEN CAST('Infinity' AS DOUBLE)
            ELSE round(count(*) / count(*) FILTER (p_size % 3 = 0), 9) END AS ts_tv_ratio
FROM part GROUP BY p_brand"""
)
def variant_stats_ingest(spark, sf):
    counts = views.table(spark, sf, "part").groupBy(F.col("p_brand").alias("src")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("p_size") % 2 == 0).alias("snps"),
        F.count_if(F.col("p_size") % 2 == 1).alias("indels"),
        F.count_if(F.col("p_size") % 3 == 0).alias("tv"),
    )
    value = F.expr(
        """array_join(array('# made by a program', concat('SN\\t0\\tnumber of records:\\t', n), concat('SN\\t0\\tnumber of SNPs:\\t', snps),
             concat('SN\\t0\\tnumber of indels:\\t', indels), 'SN\\t0\\tnumber of MNPs:\\tx',
             concat('SN\\t0\\tsample name:\\tS_', src), concat('TSTV\\t0\\t', n, '\\t', tv, '\\tn/a')), '\\n')"""
    ).alias("value")
    out = reports.ingest_variant_stats(spark, write_lines(counts.select("src", value), "vstats", "src"))
    return out.select(
        src().alias("src"), "total_records", "snps", "indels", "mnps", "singletons", "sample_name",
        F.round("ts_tv_ratio", 9).alias("ts_tv_ratio"),
    )
