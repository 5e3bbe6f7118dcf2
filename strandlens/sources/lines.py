"""Text lines with their place in the file."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlens.session import BROADCAST_MAX_ROWS, scratch_dir
from strandlens.sources import blockgzip

Paths = str | Sequence[str]

SMALL_FILE = 4 << 20
"""Files of which the header reader reads all bytes."""

FIRST_LINES = 8192
FILES_PER_JOB = 32

MOST_LINES = (1 << 31) - 1
"""The most that Spark takes as a limit."""

SCAN_TIMES = 512
"""All tasks scan a file if it has at most so many times the bytes of its header as far as that is known."""

LINE_SCHEMA = "file string, line_no bigint, value string"

# splits as large as files, and few blocks unpacked ahead of a header's end
WHOLE_FILES = {
    "spark.sql.files.maxPartitionBytes": str(1 << 60),
    "spark.sql.files.openCostInBytes": str(1 << 59),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
}


def path_list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_kinds(
    spark: SparkSession,
    paths: Paths,
    line_sep: str | None = None,
    allowed: Iterable[str] = (),
    blocks: bool | None = None,
    whole_files: bool = False,
) -> tuple[DataFrame | None, DataFrame | None]:
    """The lines of plain and of block-gzip files, None where there are none; see ``read_lines``.

    ``whole_files``: no file is split in this session, so there are no borders to mend.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    text = reader.text(path_list(paths))
    names = text.inputFiles()
    check_names(names, allowed)
    packed = {n: n.lower().endswith(blockgzip.NAMES) for n in names} if blocks is None else dict.fromkeys(names, blocks)
    file = F.col("_metadata.file_path")
    some_plain, some_packed = not all(packed.values()), any(packed.values())
    plain = members = None
    if some_plain or not names:
        # files of the other kind are left out of the listing, not read
        chosen = text.where(~blockgzip.is_block_gzip(file)) if some_packed else text
        plain = chosen.select(
            file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"
        )
    if some_packed:
        chunks = blockgzip.read_packed(spark, path_list(paths))
        chosen = chunks.where(blockgzip.is_block_gzip(F.col("file"))) if some_plain else chunks
        members = blockgzip.packed_lines(chosen, line_sep, whole_files)
    return plain, members


def read_lines(
    spark: SparkSession, paths: Paths, line_sep: str | None = None, allowed: Iterable[str] = (), blocks: bool | None = None
) -> DataFrame:
    """``(file, block, id, value)``: ``block`` is the offset of the split, ``id`` rises along it.

    Files named ``.bgz`` or ``.bgzf`` are unpacked by many tasks; ``blocks`` says so (or not) of files of any name. Any
    other suffix is Spark's to unpack.
    """
    plain, members = read_kinds(spark, paths, line_sep, allowed, blocks)
    return plain.unionByName(members) if plain is not None and members is not None else plain if members is None else members


def file_label(name: str) -> str:
    """A listed file name as ``_metadata.file_path`` spells it."""
    return re.sub("^file:/+", "file:/", name)


def check_names(files: Sequence[str], allowed: Iterable[str] = ()) -> None:
    """Refuses names that are not of the expected kind."""
    allowed = tuple(allowed)
    for name in files:
        if allowed and not name.lower().endswith(allowed):
            raise ValueError(f"{name}: expected one of {', '.join(allowed)}")


def number_lines(lines: DataFrame) -> DataFrame:
    """``(file, line_no, value)``, numbered from 1 per file, without ordering the lines.

    Lines of each split are counted; a line's number is its place in the split plus the lines
    of earlier splits.
    """
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "block", "first_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # a task reads at most one full split and the ends of files, which bounds the splits
    if lines.rdd.getNumPartitions() + len(lines.inputFiles()) <= BROADCAST_MAX_ROWS:
        offsets = F.broadcast(offsets)
    return lines.join(offsets, ["file", "block"]).select(
        "file", (F.col("before") + F.col("id") - F.col("first_id") + 1).alias("line_no"), "value"
    )


def read_numbered_lines(spark: SparkSession, paths: Paths, allowed: Iterable[str] = (), blocks: bool | None = None) -> DataFrame:
    return number_lines(read_lines(spark, paths, allowed=allowed, blocks=blocks))


def _own_session(spark: SparkSession) -> tuple[SparkSession, bool]:
    """A session of the same application with the same settings, but one split for each whole file; and whether that holds."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        # settings of a store have no entry of their own
        if spark.conf.isModifiable(key) or not key.startswith("spark."):
            own.conf.set(key, value)
    for key, value in WHOLE_FILES.items():
        own.conf.set(key, value)
    return own, all(own.conf.get(key) == value for key, value in WHOLE_FILES.items())


def _end(prefix: str, stop: str | None) -> Column:
    """For a line that ends a header the first ``id`` that is not in it, else null."""
    beyond = F.when(~F.startswith("value", F.lit(prefix)), F.col("id"))
    last = F.when(F.startswith("value", F.lit(stop)), F.col("id") + 1) if stop is not None else F.lit(None).cast("bigint")
    return F.least(beyond, last)


def _heads_of_splits(lines: DataFrame, n_files: int, prefix: str, stop: str | None) -> DataFrame:
    """Headers among all lines of files: one ends in the first split that has a line beyond it."""
    splits = lines.groupBy("file", "block").agg(
        F.min("id").alias("first_id"), F.count("*").alias("n"), F.min(_end(prefix, stop)).alias("end_id")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("ended", F.count("end_id").over(earlier) > 0)
        .where("NOT ended")
    )
    # a task reads at most one full split and the ends of files, which bounds the splits
    if lines.rdd.getNumPartitions() + n_files <= BROADCAST_MAX_ROWS:
        splits = F.broadcast(splits)
    place = F.col("before") + F.col("id") - F.col("first_id") + 1
    kept = lines.join(splits, ["file", "block"]).where(F.col("end_id").isNull() | (F.col("id") < F.col("end_id")))
    return kept.select("file", place.alias("line_no"), "value")


def _escaped(name: str) -> str:
    """A listed file name as a path that matches only this file."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(name))


def _first_lines(own: SparkSession, name: str, n: int, blocks: bool | None) -> DataFrame:
    """The first ``n`` lines of a file that is one split: its task stops there."""
    plain, packed = read_kinds(own, _escaped(name), blocks=blocks, whole_files=True)
    return (packed if plain is None else plain).select("file", "id", "value").limit(n)


def _heads_of_large(
    spark: SparkSession, own: SparkSession, sizes: dict[str, int], prefix: str, max_lines: int | None, stop: str | None, blocks: bool | None
) -> tuple[list[DataFrame], list[str]]:
    """Headers of files that are not read to their end, some read once more, further; and the files of which all splits are to be scanned.

    Those have a header that goes on, and are not much longer than what is known of it, or go on beyond any limit.
    """
    found, scanned, todo, n = [], [], list(sizes), FIRST_LINES
    while todo:
        n = n if max_lines is None else min(n, max_lines + 1)
        again = []
        for at in range(0, len(todo), FILES_PER_JOB):
            some = todo[at : at + FILES_PER_JOB]
            path = scratch_dir(spark, "first-lines")
            lines = reduce(DataFrame.unionByName, [_first_lines(own, f, n, blocks) for f in some])
            lines.write.parquet(path)
            back = spark.read.schema("file string, id bigint, value string").parquet(path)
            ends = back.groupBy("file").agg(
                F.count("*").alias("n"), F.min("id").alias("first_id"), F.min(_end(prefix, stop)).alias("end_id"),
                F.sum(F.octet_length("value") + 1).alias("bytes"),
            )
            goes_on = ends.where("end_id IS NULL").where(F.col("n") == n).collect() if max_lines is None or n <= max_lines else []
            on = {r.file: r.bytes for r in goes_on}
            again += [(f, on[file_label(f)]) for f in some if file_label(f) in on]
            # one row a file
            kept = back.join(F.broadcast(ends.where(~F.col("file").isin(*on)) if on else ends), "file")
            inside = kept.where(F.col("end_id").isNull() | (F.col("id") < F.col("end_id")))
            found.append(inside.select("file", (F.col("id") - F.col("first_id") + 1).alias("line_no"), "value"))
        n *= 64
        scanned += [f for f, known in again if n > MOST_LINES or sizes[f] <= known * SCAN_TIMES]
        todo = [f for f, _ in again if f not in set(scanned)]
    return found, scanned


def _within(heads: DataFrame, max_lines: int | None) -> DataFrame:
    """The first ``max_lines`` lines of each file, without carriage returns at their ends."""
    heads = heads if max_lines is None else heads.where(F.col("line_no") <= max_lines)
    value = F.when(F.endswith("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    return heads.select("file", "line_no", value.alias("value"))


def read_heads(
    spark: SparkSession, paths: Paths, prefix: str = "", max_lines: int | None = None, stop: str | None = None, blocks: bool | None = None
) -> DataFrame:
    """``(file, line_no, value)`` of the first lines of each file, up to the first without ``prefix``.

    The lines come through Spark's own reader, from any store and with its credentials. Small files are read whole, in one job. Of a
    large one the first lines are asked for, by a task that stops there, and more only if the header goes on; no other byte is read.
    If the header goes on and is a good part of the file, or has more lines than any limit, all tasks scan the splits of the file.
    The headers are read when this is called, and written to the scratch folder in parts of equal size: a long one is
    parsed by many tasks, and not read again, however often it is used.
    """
    own, alone = _own_session(spark)
    scanned: list[str] = []
    listed = own.read.format("binaryFile").load(path_list(paths))
    check_names(listed.inputFiles())
    if not alone:  # where splits cannot be chosen, those of the session
        heads = _heads_of_splits(read_lines(spark, paths, blocks=blocks), len(listed.inputFiles()), prefix, stop)
    else:
        sizes = dict(listed.select(F.col("_metadata.file_path"), "length").collect())
        sizes = {f: sizes[file_label(f)] for f in listed.inputFiles() if sizes.get(file_label(f))}
        small = [f for f in sizes if sizes[f] <= SMALL_FILE]
        parts = []
        if small:
            text = read_lines(spark, [_escaped(f) for f in small], blocks=blocks)
            parts.append(_heads_of_splits(text, len(small), prefix, stop))
        large = {f: size for f, size in sizes.items() if size > SMALL_FILE}
        found, scanned = _heads_of_large(spark, own, large, prefix, max_lines, stop, blocks)
        parts += found
        heads = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LINE_SCHEMA)
    path = scratch_dir(spark, "heads")
    _within(heads, max_lines).repartition("file", "line_no").write.parquet(path)
    if scanned:
        text = read_lines(spark, [_escaped(f) for f in scanned], blocks=blocks)
        rest = _within(_heads_of_splits(text, len(scanned), prefix, stop), max_lines)
        # as many tasks as splits write parts of equal size without a shuffle
        few = text.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
        (rest.repartition("file", "line_no") if few else rest).write.mode("append").parquet(path)
    return spark.read.schema(LINE_SCHEMA).parquet(path)
