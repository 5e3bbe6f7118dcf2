"""One row per file on its header, with a readable summary.

Arrays here are as long as a header, which is bounded by its file's leading lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from strandlens.sources import headers as src

# How many names a summary shows, and how it marks that there are more.
SHOWN_CONTIGS, SHOWN_SAMPLES, SHOWN_PROGRAMS = 3, 3, 2
MORE = ", …"


def _items(df: DataFrame, name: str, order: str, value: Column) -> DataFrame:
    """One row per record: ``file`` and the column ``name`` with its place and ``value``."""
    return df.select("file", F.struct(F.col(order).alias("o"), value.alias("v")).alias(name))


def _records(df: DataFrame, order: str, name: str, *fields: str) -> DataFrame:
    # entries of a map have an order, a map has none
    listed = [F.map_entries("other").alias("other") if f == "other" else F.col(f) for f in fields]
    return _items(df, name, order, F.struct(*listed))


def _in_order(name: str, kind: DataType) -> Column:
    """Array of the values in header order, with maps for listed entries."""
    sorted_ = F.sort_array(F.collect_list(name))
    value = kind["v"].dataType
    if isinstance(value, StructType) and "other" in value.names:
        return F.transform(sorted_, lambda x: x["v"].withField("other", F.map_from_entries(x["v"]["other"])))
    return F.transform(sorted_, lambda x: x["v"])


_REF = ("name", "length", "assembly", "uri", "md5", "other")
_FIELD = ("id", "number", "type", "description", "category", "other")


def alignment_header_catalog(lines: DataFrame, fmt: str = "sam") -> DataFrame:
    """References, samples, programs, metadata, comments, raw text and summary per SAM file."""
    meta = src.sam_metadata(lines)
    parts = [
        _records(src.sam_references(lines), "line_no", "references", *_REF),
        _records(src.sam_samples(lines), "line_no", "samples", *src.RG_TAGS.values(), "other"),
        _records(src.sam_programs(lines), "line_no", "programs", *src.PG_TAGS.values(), "other"),
        _items(meta.where("known"), "metadata", "key", F.col("value")),
        _items(meta.where("not known"), "header_other", "key", F.col("value")),
        _items(src.sam_comments(lines), "comments", "line_no", F.col("comment")),
    ]
    return _catalog(lines, parts, fmt)


def vcf_header_catalog(lines: DataFrame) -> DataFrame:
    """As for SAM, with INFO, FORMAT and FILTER fields."""
    fields = src.vcf_fields(lines)
    parts = [
        _records(src.vcf_references(lines), "line_no", "references", *_REF),
        _records(src.vcf_samples(lines), "position", "samples", "name"),
        *[
            _records(fields.where(F.col("category") == c), "line_no", f"{c.lower()}_fields", *_FIELD)
            for c in src.FIELD_CATEGORIES
        ],
        _items(src.vcf_metadata(lines), "metadata", "key", F.col("value")),
        _items(src.vcf_comments(lines), "comments", "line_no", F.col("comment")),
    ]
    return _catalog(lines, parts, "vcf")


def vcf_header_sizes(lines: DataFrame) -> DataFrame:
    """``(file, references, samples, first_sample)``: how long the lists of ``vcf_header_catalog`` would be, without collecting them.

    For headers too long to be one row: counts are added up by all tasks, and records are not taken apart.
    """
    zero = F.lit(0).cast("bigint")
    references = src.vcf_references(lines).groupBy("file").agg(F.count("*").alias("references"))
    samples = src.vcf_samples(lines).groupBy("file").agg(F.count("*").alias("samples"), F.min(F.struct("position", "name")).alias("first"))
    # a file whose header has neither is still one row; the least of structs sorts its rows, so only samples go there
    rows = lines.select("file").distinct().unionByName(references, allowMissingColumns=True).unionByName(samples, allowMissingColumns=True)
    return rows.groupBy("file").agg(
        F.coalesce(F.sum("references"), zero).alias("references"),
        F.coalesce(F.sum("samples"), zero).cast("int").alias("samples"),
        F.min("first")["name"].alias("first_sample"),
    )


def _catalog(lines: DataFrame, parts: list[DataFrame], fmt: str) -> DataFrame:
    """All records of all kinds grouped by file once; a line is parsed for its own kind alone."""
    rows = _items(lines, "raw", "line_no", F.col("value"))
    for part in parts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    columns = []
    for field in rows.schema.fields[1:]:
        name = field.name
        if name in ("metadata", "header_other"):
            pairs = F.transform(F.collect_list(name), lambda x: F.struct(x["o"], x["v"]))
            columns.append(F.map_from_entries(pairs).alias(name))
        else:
            columns.append(_in_order(name, field.dataType).alias(name))
    out = rows.groupBy("file").agg(*columns)
    out = out.select(
        "file", F.lit(fmt.lower()).alias("format"), F.array_join("raw", "\n").alias("raw_header"), *[c for c in out.columns[1:] if c != "raw"]
    )
    return out.withColumn("summary", header_summary(out.columns))


def header_summary(columns: list[str]) -> Column:
    """One line of text on a header; parts without content are left out."""

    def size(name: str) -> Column:
        return F.size(name) if name in columns else F.lit(0)

    def names(array: str, shown: int, more: str, pick=lambda x: x["name"]) -> Column:
        text = F.array_join(F.transform(F.slice(array, 1, shown), pick), ", ")
        return F.concat(text, F.when(F.size(array) > shown, F.lit(more)).otherwise(F.lit("")))

    def extras(name: str) -> Column:
        if name not in columns:
            return F.lit(0)
        return F.aggregate(F.transform(name, lambda x: F.size(x["other"])), F.lit(0), lambda a, x: a + x)

    parts = [F.concat(F.upper("format"), F.lit(" header"))]
    parts.append(
        F.when(
            size("references") > 0,
            F.concat(
                size("references").cast("string"),
                F.lit(" contigs (e.g., "),
                names("references", SHOWN_CONTIGS, MORE),
                F.lit(")"),
            ),
        )
    )
    parts.append(F.when(size("samples") > 0, F.concat(F.lit("samples: "), names("samples", SHOWN_SAMPLES, MORE))))
    if "programs" in columns:
        program = names(
            "programs", SHOWN_PROGRAMS, "", lambda x: F.coalesce(F.when(x["name"] != "", x["name"]), x["id"])
        )
        parts.append(F.when(size("programs") > 0, F.concat(F.lit("programs: "), program)))
    order = F.col("metadata")[F.lit("sort_order")]
    parts.append(F.when(order != "", F.concat(F.lit("sort order="), order)))
    for category in ("info", "format"):
        count = size(f"{category}_fields")
        parts.append(F.when(count > 0, F.concat(count.cast("string"), F.lit(f" {category.upper()} fields"))))
    counts = {
        "h": F.size("header_other") if "header_other" in columns else F.lit(0),
        "sq": extras("references"),
        "pg": extras("programs"),
        "rg": extras("samples") if "programs" in columns else F.lit(0),
        "vcf": extras("info_fields") + extras("format_fields") + extras("filter_fields"),
    }
    total = sum(counts.values(), F.lit(0))
    listed = F.concat_ws(",", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in counts.items()])
    parts.append(F.when(total > 0, F.concat(F.lit("extras "), listed)))
    return F.concat_ws("; ", *parts)
