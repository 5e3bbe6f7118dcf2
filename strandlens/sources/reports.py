"""QC reports made elsewhere, as tables: JSON summaries, histograms, coverage, stats sections.

JSON layouts differ between program versions, down to a field being a number in one and an
object in the other, so fields are taken out of the text by path and not by a fixed schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlens.functions.text import columns_of, map_last_wins, safe_float, safe_int, strip
from strandlens.operators.distribution import PERCENTILES
from strandlens.sources.lines import Paths, check_names, path_list, read_lines

_BINS = "array<array<double>>"


def read_documents(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(file, value)``: one report per file."""
    text = spark.read.option("wholetext", True).text(path_list(paths))
    check_names(text.inputFiles())
    return text.select(F.col("_metadata.file_path").alias("file"), "value")


def _at(doc: Column, *paths: str) -> Column:
    """First of several fields that is there; text of objects and numbers alike."""
    return F.coalesce(*[F.get_json_object(doc, f"$.{p}") for p in paths])


def _valid(doc: Column, kind: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"Invalid {kind} report JSON in "), F.col("file")))
    return F.when(F.try_parse_json(doc).isNotNull(), doc).otherwise(bad.cast("string"))


def _bins(text: Column) -> Column:
    """``[[start, end, count], …]`` to bins; null where the block is absent, empty where it is empty."""
    return F.transform(
        F.filter(F.from_json(text, _BINS), lambda b: F.size(b) >= 3),
        lambda b: F.struct(F.get(b, F.lit(0)).alias("start"), F.get(b, F.lit(1)).alias("end"), F.get(b, F.lit(2)).cast("bigint").alias("count")),
    )


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _is_object(c: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(c), F.lit("{")), F.lit(False))


def parse_read_reports(docs: DataFrame) -> DataFrame:
    """Read statistics from ``(file, value)`` of JSON text, nested or flat layout."""
    summary = docs.select("file", _valid(F.col("value"), "read").alias("d")).select(
        "file", F.coalesce(_at(F.col("d"), "summary"), F.col("d")).alias("s")
    )
    raw = F.get_json_object("s", "$.reads")
    flat = raw.isNotNull() & ~_is_object(raw)
    layout = summary.select("file", "s", flat.alias("flat"), F.when(flat, F.col("s")).otherwise(F.coalesce(raw, F.col("s"))).alias("r"))
    s, r = F.col("s"), F.col("r")

    def choose(flat_path: str, *nested: str) -> Column:
        return F.when(F.col("flat"), _at(s, flat_path)).otherwise(_at(r, *nested))

    def counted(c: Column, name: str) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"Invalid read report: {name} must be non-negative, got "), c))
        number = _number(c)
        return F.coalesce(F.when(number < 0, bad.cast("bigint")).otherwise(number.cast("bigint")), F.lit(0).cast("bigint"))

    def block(name: str) -> Column:
        return F.when(~F.col("flat"), _at(r, f"{name}.hist", f"{name}.histogram"))

    scored = F.col("flat") | F.coalesce(_at(r, "qscore") != "{}", F.lit(False))
    shares = F.when(~F.col("flat"), _at(r, "length.percentiles"))
    p = {name: _number(_at(shares, name)) for name in PERCENTILES}
    p["p50"] = F.coalesce(F.nullif(p["p50"], F.lit(0.0)), _number(_at(shares, "median")))
    zero = F.lit(0.0)
    return layout.select(
        F.coalesce(_at(s, "file"), _at(s, "input"), F.lit("unknown")).alias("source"),
        "file",
        counted(choose("reads", "count", "reads"), "read_count").alias("read_count"),
        counted(choose("bases", "bases", "total_bases"), "total_bases").alias("total_bases"),
        F.coalesce(_number(choose("shortest", "length.min")), zero).cast("bigint").alias("min_len"),
        F.coalesce(_number(choose("longest", "length.max")), zero).cast("bigint").alias("max_len"),
        F.coalesce(_number(choose("mean_length", "length.mean")), zero).alias("mean_len"),
        F.coalesce(_number(choose("median_length", "length.median", "length.p50")), zero).alias("median_len"),
        _number(choose("n50", "length.n50")).cast("bigint").alias("n50"),
        F.when(scored, F.coalesce(_number(choose("mean_quality", "qscore.mean", "qscore.average")), zero)).alias("mean_qscore"),
        F.when(scored, F.coalesce(_number(choose("median_quality", "qscore.median", "qscore.p50")), zero)).alias("median_qscore"),
        F.when(~F.col("flat"), _number(_at(r, "gc"))).alias("gc_content"),
        F.when(shares.isNotNull(), F.struct(*[c.alias(name) for name, c in p.items()])).alias("length_percentiles"),
        _bins(block("length")).alias("length_histogram"),
        _bins(block("qscore")).alias("qscore_histogram"),
    )


def ingest_read_reports(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_read_reports(read_documents(spark, paths))


def parse_alignment_reports(docs: DataFrame) -> DataFrame:
    """Alignment statistics from ``(file, value)`` of JSON text, old or new layout."""
    summary = docs.select("file", _valid(F.col("value"), "alignment").alias("d")).select(
        "file", F.coalesce(_at(F.col("d"), "summary"), F.col("d")).alias("s")
    )
    raw = F.get_json_object("s", "$.reads")
    new = F.coalesce(_at(F.col("s"), "alignment_stats"), F.lit("{}")) != "{}"
    layout = summary.select(
        "file",
        "s",
        new.alias("new"),
        F.when(~new & (raw.isNull() | _is_object(raw)), F.coalesce(raw, F.col("s"))).alias("r"),
        raw.alias("raw"),
    )
    s, r = F.col("s"), F.col("r")

    def nonzero(path: str) -> Column:
        return F.nullif(_number(_at(s, path)), F.lit(0.0))

    def either(name: str, new_path: str) -> Column:
        return F.coalesce(nonzero(name), _number(_at(s, new_path)))

    total = F.when(
        F.col("new"), F.coalesce(nonzero("alignment_stats.num_reads"), nonzero("alignment_stats.num_alignments"))
    ).otherwise(F.coalesce(_number(_at(r, "total", "reads")), F.when(r.isNull(), _number(F.col("raw")))))
    scaled = _bins(F.coalesce(_listed(s, "mapq_hist_scaled"), _listed(s, "mapq_hist_scaled_bp")))
    return layout.select(
        F.coalesce(_at(s, "file_info.path"), _at(s, "file_info.name"), _at(s, "file"), F.lit("unknown")).alias("source"),
        "file",
        F.coalesce(total, F.lit(0.0)).cast("bigint").alias("total_reads"),
        *[_number(_at(r, c)).cast("bigint").alias(c) for c in ("mapped", "unmapped", "primary", "secondary", "supplementary")],
        either("mean_length", "read_stats.mean_length").alias("mean_length"),
        either("median_length", "read_stats.median_length").alias("median_length"),
        either("n50", "read_stats.n50").cast("bigint").alias("n50"),
        either("mean_identity", "identity_stats.mean_identity").alias("mean_identity"),
        either("median_identity", "identity_stats.median_identity").alias("median_identity"),
        F.coalesce(_bins(_at(s, "mapq_hist", "mapq_histogram")), _bins(F.lit("[]"))).alias("mapq_histogram"),
        scaled.alias("mapq_histogram_scaled"),
    )


def _listed(doc: Column, path: str) -> Column:
    """Text of a list that has items."""
    text = _at(doc, path)
    return F.when(text != "[]", text)


def ingest_alignment_reports(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_alignment_reports(read_documents(spark, paths))


def _cells(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(file, id, p)``: cells of stripped, non-blank lines."""
    return (
        read_lines(spark, paths)
        .where(strip(F.col("value")) != "")
        .select("file", "block", "id", columns_of(F.col("value")).alias("p"))
    )


def ingest_histogram_tsv(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(file, start, end, count)``; lines without three numbers, such as the header, are dropped."""
    p = F.col("p")
    rows = _cells(spark, paths).where(F.size(p) >= 3).select(
        "file", safe_float(F.get(p, F.lit(0))).alias("start"), safe_float(F.get(p, F.lit(1))).alias("end"), safe_float(F.get(p, F.lit(2))).cast("bigint").alias("count")
    )
    return rows.dropna()


def ingest_coverage_summary(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(file, contig, length, bases, mean_depth)``; total and region rows are kept as written."""
    p = F.col("p")
    rows = _cells(spark, paths).where((F.size(p) >= 4) & ~F.startswith(F.get(p, F.lit(0)), F.lit("chrom")))
    return rows.select(
        "file",
        F.get(p, F.lit(0)).alias("contig"),
        F.get(p, F.lit(1)).cast("bigint").alias("length"),
        F.get(p, F.lit(2)).cast("double").alias("bases"),
        F.get(p, F.lit(3)).cast("double").alias("mean_depth"),
    )


def _region_cells(spark: SparkSession, paths: Paths) -> DataFrame:
    p = F.col("p")
    return _cells(spark, paths).where(~F.startswith(F.get(p, F.lit(0)), F.lit("#")) & (F.size(p) >= 4))


def ingest_region_depth(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(file, contig, start, end, mean_depth)``; the depth is the last column, named regions or not."""
    p = F.col("p")
    return _region_cells(spark, paths).select(
        "file",
        F.get(p, F.lit(0)).alias("contig"),
        F.get(p, F.lit(1)).cast("bigint").alias("start"),
        F.get(p, F.lit(2)).cast("bigint").alias("end"),
        F.element_at(p, -1).cast("double").alias("mean_depth"),
    )


def ingest_region_thresholds(
    spark: SparkSession, paths: Paths, thresholds: Sequence[int] = (1, 10, 20), unit: str = "fraction"
) -> DataFrame:
    """``(file, contig, start, end, pct_coverage_{t}x …)`` from the last columns.

    ``unit`` tells whether these are fractions of the region or counts of its bases. A region
    listed twice keeps its last line.
    """
    if unit not in ("fraction", "bases"):
        raise ValueError(f"unit must be 'fraction' or 'bases', got {unit!r}")
    p, n = F.col("p"), len(thresholds)
    rows = _region_cells(spark, paths).where(F.size(p) >= 3 + n).select(
        "file",
        "block",
        "id",
        F.get(p, F.lit(0)).alias("contig"),
        F.get(p, F.lit(1)).cast("bigint").alias("start"),
        F.get(p, F.lit(2)).cast("bigint").alias("end"),
        F.transform(F.slice(p, -n, n), lambda x: x.cast("double")).alias("v"),
    )
    last = rows.groupBy("file", "contig", "start", "end").agg(F.max_by("v", F.struct("block", "id")).alias("v"))
    width = F.lit(1.0) if unit == "fraction" else F.col("end") - F.col("start")
    return last.select(
        "file", "contig", "start", "end", *[(F.get("v", F.lit(i)) * 100.0 / width).alias(f"pct_coverage_{t}x") for i, t in enumerate(thresholds)]
    )


def ingest_stats_sections(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(file, section, key, key_num, value)`` of the lines SN, COV, GCD, MPC and IS.

    SN keys are lower-case and values without the trailing remark; COV gives bases by depth,
    also for written ranges ``[10-10]``. Malformed lines are dropped.
    """
    cells = read_lines(spark, paths).select("file", "block", "id", F.split("value", "\t").alias("p"))
    p = F.col("p")
    section = F.get(p, F.lit(0))
    second, third, fourth = (strip(F.get(p, F.lit(i))) for i in (1, 2, 3))
    named = F.regexp_extract(second, r"^(.+?):$", 1)
    ranged = F.regexp_extract(second, r"^\[(\d+)-\d+\]$", 1)
    # a range is followed by its depth and then by the count
    cov_depth = F.when(ranged != "", third).when(second.rlike("^[0-9]+$"), second)
    cov_count = F.when(ranged != "", fourth).otherwise(third)
    rows = cells.select(
        "file",
        "block",
        "id",
        section.alias("section"),
        F.when(section == "SN", F.lower(F.trim(named))).alias("key"),
        F.when(section == "COV", safe_int(cov_depth).cast("double"))
        .when(section == "MPC", safe_int(second).cast("double"))
        .when(section.isin("GCD", "IS"), safe_float(second))
        .alias("key_num"),
        F.when(section == "SN", third)
        .when(section == "COV", safe_float(cov_count).cast("bigint").cast("string"))
        .when(section == "GCD", F.when(fourth.rlike("^[0-9]+$"), fourth))
        .when(section == "MPC", safe_float(third).cast("string"))
        .when(section == "IS", safe_float(third).cast("bigint").cast("string"))
        .alias("value"),
    ).where(
        section.isin("SN", "COV", "GCD", "MPC", "IS")
        & F.col("value").isNotNull()
        & F.when(F.col("section") == "SN", F.coalesce(F.col("key"), F.lit("")) != "").otherwise(F.col("key_num").isNotNull())
    )
    single = rows.where(F.col("section").isin("SN", "MPC")).groupBy("file", "section", "key", "key_num").agg(
        F.max_by("value", F.struct("block", "id")).alias("value")
    )
    many = rows.where(~F.col("section").isin("SN", "MPC")).select("file", "section", "key", "key_num", "value")
    return single.unionByName(many)


def error_rates_of_sections(sections: DataFrame) -> DataFrame:
    """``(file, mismatch_rate, insertion_rate, deletion_rate)``; mismatches fall back to the error rate."""

    def rate(key: str) -> Column:
        chosen = (F.col("section") == "SN") & (F.col("key") == key)
        return F.max(F.when(chosen, safe_float(F.col("value"))))

    return sections.groupBy("file").agg(
        F.coalesce(rate("mismatches per base"), rate("error rate")).alias("mismatch_rate"),
        rate("insertions per base").alias("insertion_rate"),
        rate("deletions per base").alias("deletion_rate"),
    )


def ingest_variant_stats(
    spark: SparkSession, paths: Paths, include_snps: bool = True, include_indels: bool = True
) -> DataFrame:
    """``(file, total_records, snps, indels, mnps, others, singletons, sample_name, ts_tv_ratio)``.

    Read from the lines SN and TSTV, the latter with or without a sample column. A ratio that
    is no number is computed from the counts: null if both are 0, infinite if only tv is.
    """
    cells = _cells(spark, paths).where(~F.startswith(F.get("p", F.lit(0)), F.lit("#")) & (F.size("p") >= 4))
    p = F.col("p")
    key = F.when(F.get(p, F.lit(0)) == "SN", F.lower(F.get(p, F.lit(2))))
    wide = F.size(p) >= 5
    ts = safe_int(F.when(wide, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1))))
    tv = safe_int(F.when(wide, F.get(p, F.lit(3))).otherwise(F.get(p, F.lit(2))))
    text = F.when(wide, F.get(p, F.lit(4))).otherwise(F.get(p, F.lit(3)))
    counted = F.when(tv > 0, ts / tv).when((ts == 0) & (tv == 0), F.lit(None)).when(ts > 0, F.lit(float("inf"))).otherwise(0.0)
    ratio = F.when((F.get(p, F.lit(0)) == "TSTV") & ts.isNotNull() & tv.isNotNull(), F.struct(F.coalesce(safe_float(text), counted).alias("ratio")))
    # Parts of the SN keys, in the order they are tried.
    names = {
        "number of records": "total_records",
        "number of mnps": "mnps",
        "number of others": "others",
        "number of singletons": "singletons",
        "sample name": "sample_name",
        "number of snps": "snps",
        "number of indels": "indels",
    }
    field = F.lit(None).cast("string")
    for part, name in reversed(list(names.items())):
        field = F.when(F.contains(key, F.lit(part)), name).otherwise(field)
    rows = cells.select("file", F.struct("block", "id").alias("place"), field.alias("field"), F.get(p, F.lit(3)).alias("v"), ratio.alias("ratio"))

    def latest(name: str) -> Column:
        value = F.when(F.col("field") == name, F.col("v") if name == "sample_name" else safe_int(F.col("v")).cast("string"))
        return F.max_by(value, F.when(value.isNotNull(), F.col("place")))

    def number(name: str, default: int | None = None) -> Column:
        got = latest(name).cast("bigint")
        return got if default is None else F.coalesce(got, F.lit(default).cast("bigint"))

    out = rows.groupBy("file").agg(
        number("total_records", 0).alias("total_records"),
        number("snps", 0).alias("snps"),
        number("indels", 0).alias("indels"),
        number("mnps", 0).alias("mnps"),
        number("others", 0).alias("others"),
        number("singletons").alias("singletons"),
        latest("sample_name").alias("sample_name"),
        F.max_by("ratio", F.when(F.col("ratio").isNotNull(), F.col("place"))).alias("r"),
    ).withColumn("ts_tv_ratio", F.col("r.ratio")).drop("r")
    if not include_snps:
        out = out.withColumns({"snps": F.lit(None).cast("bigint"), "ts_tv_ratio": F.lit(None).cast("double")})
    if not include_indels:
        out = out.withColumn("indels", F.lit(None).cast("bigint"))
    return out
