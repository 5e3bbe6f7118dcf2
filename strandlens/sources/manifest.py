"""Which input files there are and whether they can be used."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlens.sources.lines import Paths, file_label, path_list

LOOKUPS = 32

# Formats by file name ending.
FORMATS = {
    "fastq": (".fastq", ".fq", ".fastq.gz", ".fq.gz", ".fastq.bgz", ".fq.bgz"),
    "sam": (".sam", ".sam.gz"),
    "bam": (".bam",),
    "cram": (".cram",),
    "vcf": (".vcf", ".vcf.gz", ".vcf.bgz"),
    "bcf": (".bcf",),
    "bed": (".bed", ".bed.gz"),
    "gff3": (".gff", ".gff3", ".gff.gz", ".gff3.gz"),
}


def file_manifest(
    spark: SparkSession, paths: Paths, allowed: Sequence[str] = (), max_bytes: int | None = None
) -> DataFrame:
    """``(file, length, modified, format, status)`` without reading any content.

    ``status`` is ok, empty, too_large, bad_extension, not_a_file (a folder, given by its own path) or missing. Files are
    listed by Spark, in parallel where there are many; given paths are looked up ``LOOKUPS`` at a time. A pattern that matches folders
    stands for the files in them.
    """
    name = F.lower("file")
    fmt = F.lit(None).cast("string")
    for label, endings in FORMATS.items():
        fmt = F.when(_ends(name, endings), label).otherwise(fmt)
    status = F.when(F.col("length") == 0, "empty")
    if max_bytes is not None:
        status = status.when(F.col("length") > max_bytes, "too_large")
    if allowed:
        status = status.when(~_ends(name, allowed), "bad_extension")
    listed = list(dict.fromkeys(path_list(paths)))
    kinds = _kinds(spark, listed)
    present = [p for p in listed if kinds[p] == "file"]
    rows = [(p, kinds[p]) for p in listed if kinds[p] != "file"]
    gone = spark.createDataFrame(rows, "file string, status string")
    if not present:
        return gone.selectExpr(
            "file", "cast(null as bigint) length", "cast(null as timestamp) modified", "cast(null as string) format", "status"
        )
    found = spark.read.format("binaryFile").load(present)
    # Spark makes no rows for files without bytes, so these are taken from its listing
    names = spark.createDataFrame([(file_label(f),) for f in found.inputFiles()], "file string")
    sized = found.select(F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified"))
    out = (
        names.join(sized, "file", "left")
        .withColumn("length", F.coalesce("length", F.lit(0)))
        .select("file", "length", "modified", fmt.alias("format"), status.otherwise("ok").alias("status"))
    )
    return out.unionByName(gone, allowMissingColumns=True) if rows else out


def _kinds(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """``file`` (also a pattern that matches any), ``not_a_file`` or ``missing`` for each path, by some lookups at a time."""
    conf, places = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path

    def kind(path: str) -> str:
        place = places(path)
        found = place.getFileSystem(conf).globStatus(place)
        if found is None or not len(found):
            return "missing"
        plain = not set("*?[{") & set(path)
        return "not_a_file" if plain and found[0].isDirectory() else "file"

    with ThreadPoolExecutor(LOOKUPS) as pool:
        return dict(zip(paths, pool.map(kind, paths), strict=True))


def _ends(name, endings):
    return name.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")
