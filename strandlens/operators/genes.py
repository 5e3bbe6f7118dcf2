"""Gene lookup in annotation features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlens.session import scratch_dir

MAX_DEPTH = 64

# Feature types, in lower case.
GENE, TRANSCRIPTS, EXON = "gene", ("mrna", "transcript"), "exon"


def attr(name: str) -> Column:
    """Attribute in lower case, empty where absent."""
    return F.coalesce(F.lower(F.col("attrs")[F.lit(name)]), F.lit(""))


def _is_named(features: DataFrame, names: DataFrame | str) -> DataFrame:
    """Genes matching a name by ID or Name, with the asked name in ``gene``."""
    genes = features.where((F.lower("type") == GENE) & F.col("start").isNotNull() & F.col("end").isNotNull())
    if isinstance(names, str):
        wanted = names.lower()
        return genes.where((attr("id") == wanted) | (attr("name") == wanted)).withColumn("gene", F.lit(names))
    keyed = genes.withColumn("_key", F.explode(F.array_distinct(F.array(attr("id"), attr("name")))))
    asked = names.select(F.col("gene"), F.lower("gene").alias("_key")).distinct()
    return keyed.join(asked, "_key").drop("_key")


def find_gene(features: DataFrame, gene: DataFrame | str, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, gene, contig, start, end, gene_id)``: span of the first matching gene in file order.

    ``gene`` is a name, or a table with a column ``gene`` to look up many at once. Names match
    the ID or Name attribute in any case; genes without whole-number coordinates are passed over.
    Coordinates stay as written (1-based, inclusive in GFF3); see ``one_based`` of ``gene_regions``.
    """
    return (
        _is_named(features, gene)
        .groupBy(*by, "gene")
        .agg(
            F.min_by(
                F.struct("seqid", "start", "end", F.coalesce(F.col("attrs")[F.lit("id")], F.lit("")).alias("gene_id")), "line_no"
            ).alias("hit")
        )
        .select(*by, "gene", F.col("hit.seqid").alias("contig"), F.col("hit.start").alias("start"),
                F.col("hit.end").alias("end"), F.col("hit.gene_id").alias("gene_id"))
    )


def gene_regions(features: DataFrame, gene: DataFrame | str, by: Sequence[str] = ("file",), one_based: bool = False) -> DataFrame:
    """Gene spans as regions for coverage; ``one_based`` turns GFF3 coordinates into half-open ones."""
    shift = 1 if one_based else 0
    return find_gene(features, gene, by).select(
        *by, "contig", (F.col("start") - shift).alias("start"), "end", F.col("gene").alias("name")
    )


def gene_exons(features: DataFrame, gene: DataFrame | str, by: Sequence[str] = ("file",)) -> DataFrame:
    """``(*by, gene, contig, start, end)`` of exons under the transcripts of a gene.

    Two equi-joins along the parent attribute. An exon below two transcripts of one gene comes out once.
    """
    found = find_gene(features, gene, by).where(F.col("gene_id") != "").select(
        *by, "gene", F.lower("gene_id").alias("parent")
    )
    transcripts = (
        features.where(F.lower("type").isin(*TRANSCRIPTS) & (attr("id") != ""))
        .select(*by, attr("parent").alias("parent"), attr("id").alias("transcript"))
        .join(found, [*by, "parent"])
        .select(*by, "gene", F.col("transcript").alias("parent"))
        .distinct()
    )
    return (
        features.where((F.lower("type") == EXON) & F.col("start").isNotNull() & F.col("end").isNotNull())
        .select(*by, attr("parent").alias("parent"), F.col("seqid").alias("contig"), "start", "end")
        .join(transcripts, [*by, "parent"])
        .select(*by, "gene", "contig", "start", "end")
    )


def gene_descendants(
    features: DataFrame, gene: DataFrame | str, by: Sequence[str] = ("file",), types: Sequence[str] | None = None, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """``(*by, gene, line_no, type, contig, start, end, depth)`` of all features below a gene, however deep.

    A feature may have several parents, parted by commas; it comes out once per gene, with the least number of
    steps to it. ``types`` (in any case) chooses what comes out, not what is followed. Each round joins the features met last
    with those that name them as parent. A round beyond ``max_depth`` means that features are their own ancestors: an error.
    """
    by = list(by)
    spark = features.sparkSession
    parents = F.explode(F.filter(F.transform(F.split(attr("parent"), ","), lambda p: F.trim(p)), lambda p: p != ""))
    path = scratch_dir(spark, "features")
    links = features.select(*by, "line_no", attr("id").alias("id"), "type", "seqid", "start", "end", parents.alias("parent"))
    links.write.parquet(path)
    links = spark.read.schema(links.schema).parquet(path)
    met = find_gene(features, gene, by).where(F.col("gene_id") != "").select(*by, "gene", F.lower("gene_id").alias("parent"))
    levels = []
    for depth in range(1, max_depth + 2):
        below = links.join(met, [*by, "parent"]).drop("parent").distinct().withColumn("depth", F.lit(depth))
        path = scratch_dir(spark, "features-below")
        below.write.parquet(path)
        below = spark.read.schema(below.schema).parquet(path)
        if below.isEmpty():
            break
        if depth > max_depth:
            raise ValueError(f"Features are nested more than {max_depth} deep, or are their own ancestors")
        levels.append(below)
        met = below.where(F.col("id") != "").select(*by, "gene", F.col("id").alias("parent")).distinct()
    else:
        raise ValueError(f"Features are nested more than {max_depth} deep, or are their own ancestors")
    found = below
    for level in levels:
        found = found.unionByName(level)
    if types is not None:
        found = found.where(F.lower("type").isin(*[t.lower() for t in types]))
    keys = [*by, "gene", "line_no", "type", F.col("seqid").alias("contig"), "start", "end"]
    return found.groupBy(*keys).agg(F.min("depth").alias("depth"))
