"""SAM and VCF headers as tables, many files at once.

Only leading lines are read, once (see ``read_heads``). The functions taking ``lines`` work on
``(file, line_no, value)`` from any other place as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlens.functions.text import angle_map, columns_of, has_angle_value, strip, tag_map
from strandlens.sources.lines import Paths, read_heads

# Known tags by record type and the field each one fills.
HD_TAGS = {"VN": "version", "SO": "sort_order", "GO": "group_order"}
SQ_TAGS = {"SN": "name", "LN": "length", "AS": "assembly", "UR": "uri", "M5": "md5"}
RG_TAGS = {
    "SM": "name",
    "ID": "read_group_id",
    "LB": "library",
    "PL": "platform",
    "PU": "platform_unit",
    "CN": "sequencing_center",
    "DT": "run_date",
    "FC": "flowcell_id",
    "PM": "platform_model",
    "DS": "description",
}
PG_TAGS = {"ID": "id", "PN": "name", "VN": "version", "CL": "command", "PP": "previous_id"}
CONTIG_KEYS = ("ID", "length", "Length", "assembly", "Assembly", "URI", "url", "md5")
FIELD_KEYS = {"ID": "id", "Number": "number", "Type": "type", "Description": "description"}
FIELD_CATEGORIES = ("INFO", "FORMAT", "FILTER")


def sam_header_lines(spark: SparkSession, paths: Paths, blocks: bool | None = None) -> DataFrame:
    return read_heads(spark, paths, prefix="@", blocks=blocks)


def vcf_header_lines(spark: SparkSession, paths: Paths, max_lines: int | None = None, blocks: bool | None = None) -> DataFrame:
    """Header lines up to ``#CHROM`` or the first line of data.

    With ``max_lines`` a longer header is cut there, and the column ``cut`` says so on each of its lines.
    """
    if max_lines is None:
        return read_heads(spark, paths, prefix="#", stop="#CHROM", blocks=blocks)
    lines = read_heads(spark, paths, prefix="#", max_lines=max_lines + 1, stop="#CHROM", blocks=blocks)
    longest = F.max("line_no").over(Window.partitionBy("file"))
    return lines.withColumn("cut", longest > max_lines).where(F.col("line_no") <= max_lines)


def require_header(lines: DataFrame, paths: Paths) -> DataFrame:
    """The lines again, or an error when not one of the files has a header line."""
    if lines.isEmpty():
        raise ValueError(f"No VCF header lines found in {paths}")
    return lines


def _digits(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))


def _rest(tags: Column, known: Sequence[str]) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(*known))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _sam_records(lines: DataFrame, kind: str) -> DataFrame:
    parts = columns_of(F.col("value"))
    return lines.where(F.get(parts, F.lit(0)) == f"@{kind}").select(
        "file", "line_no", tag_map(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("t")
    )


def sam_references(lines: DataFrame) -> DataFrame:
    """``(file, line_no, name, length, assembly, uri, md5, other)``; records without a name are dropped."""
    t = F.col("t")
    return _sam_records(lines, "SQ").where(F.coalesce(t["SN"], F.lit("")) != "").select(
        "file",
        "line_no",
        *[(_digits(t[k]) if k == "LN" else t[k]).alias(v) for k, v in SQ_TAGS.items()],
        _rest(t, tuple(SQ_TAGS)).alias("other"),
    )


def sam_samples(lines: DataFrame) -> DataFrame:
    """Read groups; the name is SM, else ID, else ``unknown``."""
    t = F.col("t")
    name = F.coalesce(_filled(t["SM"]), _filled(t["ID"]), F.lit("unknown"))
    return _sam_records(lines, "RG").select(
        "file",
        "line_no",
        *[(name if k == "SM" else t[k]).alias(v) for k, v in RG_TAGS.items()],
        _rest(t, tuple(RG_TAGS)).alias("other"),
    )


def sam_programs(lines: DataFrame) -> DataFrame:
    """Programs; the id is ID, else PN, else ``unknown``."""
    t = F.col("t")
    ident = F.coalesce(_filled(t["ID"]), _filled(t["PN"]), F.lit("unknown"))
    return _sam_records(lines, "PG").select(
        "file",
        "line_no",
        *[(ident if k == "ID" else t[k]).alias(v) for k, v in PG_TAGS.items()],
        _rest(t, tuple(PG_TAGS)).alias("other"),
    )


def sam_metadata(lines: DataFrame) -> DataFrame:
    """``(file, key, value, known)`` of ``@HD``; unknown tags keep their own name. The last one counts."""
    named = F.create_map(*[F.lit(x) for pair in HD_TAGS.items() for x in pair])
    rows = _sam_records(lines, "HD").select("file", "line_no", F.explode("t").alias("tag", "value"))
    known = F.col("tag").isin(*HD_TAGS)
    return (
        rows.where(~known | (F.col("value") != ""))
        .groupBy("file", "tag")
        .agg(F.max_by("value", "line_no").alias("value"))
        .select("file", F.coalesce(named[F.col("tag")], F.col("tag")).alias("key"), "value", known.alias("known"))
    )


def sam_comments(lines: DataFrame) -> DataFrame:
    parts = columns_of(F.col("value"))
    return lines.where(F.get(parts, F.lit(0)) == "@CO").select(
        "file", "line_no", F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "\t").alias("comment")
    )


def _vcf_items(lines: DataFrame) -> DataFrame:
    body = F.substring("value", F.lit(3), F.length("value"))
    at = F.locate("=", body)
    return lines.where(F.startswith("value", F.lit("##")) & (at > 0)).select(
        "file", "line_no", F.substring(body, F.lit(1), at - 1).alias("key"), F.substring(body, at + 1, F.length(body)).alias("v")
    )


def vcf_references(lines: DataFrame) -> DataFrame:
    a = F.col("a")

    def either(*keys: str) -> Column:
        return F.coalesce(*[_filled(a[k]) for k in keys])

    named = _vcf_items(lines).where((F.upper("key") == "CONTIG") & has_angle_value(F.col("v"), "ID"))
    items = named.select("file", "line_no", angle_map(F.col("v")).alias("a"))
    return items.select(
        "file",
        "line_no",
        a["ID"].alias("name"),
        _digits(either("length", "Length")).alias("length"),
        either("assembly", "Assembly").alias("assembly"),
        either("URI", "url").alias("uri"),
        a["md5"].alias("md5"),
        _rest(a, CONTIG_KEYS).alias("other"),
    )


def vcf_fields(lines: DataFrame) -> DataFrame:
    """``(file, line_no, category, id, number, type, description, other)`` of INFO, FORMAT and FILTER."""
    a = F.col("a")
    items = (
        _vcf_items(lines)
        .withColumn("category", F.upper("key"))
        .where(F.col("category").isin(*FIELD_CATEGORIES))
        .select("file", "line_no", "category", angle_map(F.col("v")).alias("a"))
    )
    return items.where(F.coalesce(a["ID"], F.lit("")) != "").select(
        "file", "line_no", "category", *[a[k].alias(v) for k, v in FIELD_KEYS.items()], _rest(a, tuple(FIELD_KEYS)).alias("other")
    )


def vcf_metadata(lines: DataFrame) -> DataFrame:
    """``(file, key, value)`` of all other ``##key=value`` lines; the last one of a key counts."""
    return (
        _vcf_items(lines)
        .where(~F.upper("key").isin("CONTIG", *FIELD_CATEGORIES))
        .groupBy("file", "key")
        .agg(strip(F.max_by("v", "line_no")).alias("value"))
    )


def vcf_samples(lines: DataFrame) -> DataFrame:
    """``(file, position, name)`` of the sample columns, from 1."""
    parts = columns_of(F.col("value"))
    return lines.where(F.startswith("value", F.lit("#CHROM"))).select(
        "file", F.posexplode(F.slice(parts, 10, F.greatest(F.size(parts) - 9, F.lit(0)))).alias("position", "name")
    ).withColumn("position", F.col("position") + 1)


def vcf_comments(lines: DataFrame) -> DataFrame:
    plain = ~F.startswith("value", F.lit("##")) & ~F.startswith("value", F.lit("#CHROM"))
    return lines.where(F.startswith("value", F.lit("#")) & plain).select("file", "line_no", F.col("value").alias("comment"))
