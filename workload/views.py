"""Sequencing tables derived from the driver's tables, whole tables and whole texts.

Reads are the documents: each letter of a text becomes a base and a quality. Alignments are
line items: ship date and quantity give position and cigar. The SQL of the same views is in
``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How letters of a text turn into bases and qualities.
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
BASES = ("ACGT" * 7)[:26]
QUALITIES = "".join(chr(43 + i) for i in range(26))

TILE = 256
BIN = 128


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the table comes as fewer splits, as a small one does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("file"),
        F.floor(F.col("value") * 100).cast("bigint").alias("length"),
        (micros / 1e6).alias("start_time"),
        (F.col("value") / 10).alias("qscore"),
        F.col("user_id").alias("channel"),
        F.col("event_id"),
    )


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("file"), F.col("n_chars").alias("length"))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"))
    return docs.select(
        F.col("source").alias("file"),
        F.col("doc_id").alias("rec"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("read_id"),
        F.regexp_replace(F.translate("text", LOWER + UPPER, BASES * 2), "[^ACGT]", "N").alias("seq"),
        F.regexp_replace(F.translate("text", LOWER, QUALITIES), "[^+-D]", "5").alias("qual"),
    )


_KIND = "(CASE WHEN l_linenumber IN (1, 7) THEN 'B' WHEN l_linenumber IN (3, 5) THEN 'C' ELSE 'A' END)"


def alignments(spark: SparkSession, sf: str) -> DataFrame:
    items = spread(table(spark, sf, "lineitem")).selectExpr(
        "l_linestatus file",
        "concat(l_orderkey, '/', l_linenumber, '/', l_partkey) qname",
        f"{_KIND} kind",
        "cast(l_linenumber as bigint) k",
        "cast(l_quantity as bigint) q",
        "l_suppkey s",
        "l_partkey p",
        "l_discount",
        "l_returnflag contig",
        "cast(datediff(cast(l_shipdate as date), date'1992-01-01') as bigint) pos",
    )
    return items.selectExpr(
        "file",
        "qname",
        """cast(CASE k WHEN 1 THEN 67 WHEN 2 THEN 16 WHEN 3 THEN 0 WHEN 4 THEN 256 WHEN 5 THEN 16 WHEN 6 THEN 2048
           ELSE CASE WHEN s % 2 = 0 THEN 4 ELSE 1024 END END as int) flag""",
        "contig",
        "pos",
        "cast(s % 61 as int) mapq",
        """CASE kind WHEN 'A' THEN concat(k, 'S', q, 'M', k, 'D', q + 5, 'M2I10M')
           WHEN 'B' THEN concat(q, 'M') ELSE concat(q, '=1X', q, '=', 20 * k, 'N7M4S3H') END cigar""",
        "'=' rnext",
        "pos pnext",
        "CASE WHEN k = 1 THEN (100 + p % 400) * (CASE WHEN s % 2 = 0 THEN 1 ELSE -1 END) ELSE 0 END tlen",
        """substr(repeat('GCATTACGGA', 14), cast(1 + s % 10 as int),
           cast(CASE kind WHEN 'A' THEN k + 2 * q + 17 WHEN 'B' THEN q ELSE 2 * q + 12 END as int)) seq""",
        """substr(repeat('5?I+', 40), cast(1 + p % 4 as int),
           cast(CASE kind WHEN 'A' THEN k + 2 * q + 17 WHEN 'B' THEN q ELSE 2 * q + 12 END as int)) qual""",
        """map_filter(map(
             'NM', cast(CASE kind WHEN 'A' THEN 4 + k WHEN 'B' THEN 0 ELSE 1 END as string),
             'MD', CASE kind
                   WHEN 'A' THEN concat(q - 1, 'A0^', repeat('C', cast(k as int)),
                                        CASE WHEN q % 2 = 0 THEN q % 7 ELSE q + 6 END, 'T',
                                        q + 14 - CASE WHEN q % 2 = 0 THEN q % 7 ELSE q + 6 END)
                   WHEN 'B' THEN cast(q as string) ELSE concat(q, 'G', q + 7) END,
             'de', CASE WHEN k = 1 THEN cast(l_discount as string) END), (t, v) -> v IS NOT NULL) tags""",
    )


def references(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").selectExpr(
        "explode(array('F', 'O')) file",
        "substr('ANRZY', r_regionkey + 1, 1) contig",
        "cast(4000 + 100 * r_regionkey as bigint) length",
    )


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    return references(spark, sf).select("file").distinct()


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey line_no",
        "substr('ANRZ', cast(p_partkey % 4 + 1 as int), 1) contig",
        "(p_partkey * 37) % 3600 start",
        "(p_partkey * 37) % 3600 + p_size end",
        "CASE WHEN p_partkey % 5 > 0 THEN p_name END name",
    )


def bed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of interval files, some of them wrong, some comments."""
    return table(spark, sf, "part").selectExpr(
        "p_type file",
        "p_partkey line_no",
        r"""CASE WHEN p_partkey % 13 = 0 THEN concat('#', p_name)
             WHEN p_partkey % 11 = 3 THEN concat('chr1\t', p_size)
             WHEN p_partkey % 11 = 5 THEN concat('chr1\tabc\t', p_size, '\tx')
             WHEN p_partkey % 11 = 7 THEN concat('chr2\t', p_size, '\t7.5')
             WHEN p_partkey % 11 = 9 THEN concat('chr3\t', p_size, '\t', 20, '\t', p_name)
             ELSE concat('  chr', p_size % 3, '\t', p_partkey, '\t ', p_partkey + p_size, '\t', p_name, '\t') END value""",
    )


def variants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_type file",
        "p_brand chrom",
        "p_partkey pos",
        "'.' id",
        """CASE p_size % 5 WHEN 3 THEN 'AT' WHEN 4 THEN 'AC'
           ELSE substr('ACGT', cast(p_partkey % 4 + 1 as int), 1) END ref""",
        """filter(array(
             CASE p_size % 5 WHEN 3 THEN 'A' WHEN 4 THEN 'GT'
                  WHEN 2 THEN concat(substr('ACGT', cast(p_partkey % 4 + 1 as int), 1), 'GG')
                  ELSE substr('ACGT', cast((p_partkey + 1 + p_size % 3) % 4 + 1 as int), 1) END,
             CASE WHEN p_partkey % 7 = 0 THEN '<DEL>' END,
             CASE WHEN p_partkey % 9 = 0 THEN '*' END), a -> a IS NOT NULL) alts""",
        "p_retailprice qual",
        "'PASS' filter",
        "map('DP', cast(p_size as string)) info",
        "array('GT', 'DP') format",
        """array(concat(CASE p_size % 3 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END, ':', p_size),
                 concat(CASE p_partkey % 3 WHEN 0 THEN './.' WHEN 1 THEN '0|2' ELSE '1|0' END, ':', p_size)) samples""",
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    genes = table(spark, sf, "region").selectExpr(
        "'g' file",
        "cast(r_regionkey as bigint) line_no",
        "concat('chr', r_regionkey) seqid",
        "'gene' type",
        "cast(r_regionkey * 100000 + 1 as bigint) start",
        "cast((r_regionkey + 1) * 100000 as bigint) end",
        "map('id', concat('Gene', r_regionkey), 'name', r_name) attrs",
    )
    transcripts = table(spark, sf, "nation").selectExpr(
        "'g' file",
        "cast(1000 + n_nationkey as bigint) line_no",
        "concat('chr', n_regionkey) seqid",
        "CASE WHEN n_nationkey % 2 = 0 THEN 'mRNA' ELSE 'transcript' END type",
        "cast(n_nationkey as bigint) start",
        "cast(n_nationkey + 500 as bigint) end",
        "map('id', concat('TX', n_nationkey), 'parent', concat('gene', n_regionkey)) attrs",
    )
    exons = table(spark, sf, "supplier").selectExpr(
        "'g' file",
        "10000 + s_suppkey line_no",
        "concat('chr', s_nationkey) seqid",
        "CASE WHEN s_suppkey % 10 = 0 THEN 'CDS' ELSE 'exon' END type",
        "s_suppkey * 10 + 1 start",
        "s_suppkey * 10 + 8 end",
        "map('id', concat('exon', s_suppkey), 'parent', concat('tx', s_nationkey)) attrs",
    )
    return genes.unionByName(transcripts).unionByName(exons)
