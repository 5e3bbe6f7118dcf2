"""Block-gzip (BGZF) text, read by many tasks and written, on any store that Spark reads.

Such a file is a row of small gzip members, each with its own length in its header. Spark's text
reader splits it at the first bytes of a member, so every task unpacks the members that begin in its split. Lines that
a split border cuts are put together from the pieces on both sides, at most two per split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How a member begins, the 16 bytes that writers put there, and the empty member at the end of a file.
MAGIC = bytes.fromhex("1f8b0804")
HEADER = bytes.fromhex("1f8b08040000000000ff060042430200")
EMPTY = HEADER + bytes.fromhex("1b0003000000000000000000")
MEMBER_BYTES = 65280

NAMES = (".bgz", ".bgzf")
ENCODING = "ISO-8859-1"  # one byte a character, for the separators given to Spark
BATCH_BYTES = 1 << 20
RATIO = 1100
"""More than deflate can make of a byte, so that line numbers of one split stay below those of the next."""

WHOLE, HEAD, TAIL, MIDDLE = range(4)


def is_block_gzip(file: Column) -> Column:
    return F.lower(file).rlike(r"\.bgzf?$")


def _members(chunks: Iterator[bytes], file: str) -> Iterator[bytes]:
    """Whole members from what lies between their first bytes; those bytes may occur inside one, too."""
    held = b""
    for chunk in chunks:
        held += MAGIC + chunk
        size = _size(held, file)
        if len(held) > size:
            raise ValueError(f"Bytes between the blocks of {file}")
        if len(held) == size:
            yield held
            held = b""
    if held:
        raise ValueError(f"A block is not complete in {file}: the file was cut, or a split ends inside it")


def _size(member: bytes, file: str) -> int:
    """Length of a member, from the extra field of its header."""
    at, end = 12, 12 + int.from_bytes(member[10:12], "little")
    while at + 4 <= min(end, len(member)):
        size = int.from_bytes(member[at + 2 : at + 4], "little")
        if member[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(member[at + 4 : at + 6], "little") + 1
        at += 4 + size
    raise ValueError(f"{file} is gzip, but not in blocks: rename it to end in .gz")


def _unpacked(chunks: Iterator[bytes], file: str) -> Iterator[bytes]:
    for member in _members(chunks, file):
        text = zlib.decompress(member, 31)
        if text:
            yield text


def _pieces(texts: Iterator[bytes], sep: bytes, starts: bool, borders: bool) -> Iterator[tuple[list[bytes], int, int]]:
    """(pieces, number of the first, kind) of one split, in order; ``borders`` leaves out the whole lines.

    ``starts``: the split begins with a line. Otherwise the first piece belongs to a line of an earlier split.
    """
    number, first, open_parts, edge = 0, not starts, [], b""
    for text in texts:
        # of a line over many members only the end is looked at again
        if sep not in edge + text:
            open_parts.append(text)
            edge = (edge + text)[1 - len(sep) :] if len(sep) > 1 else b""
            continue
        text = b"".join([*open_parts, text])
        if first:
            head, _, text = text.partition(sep)
            yield [head], -1, HEAD
            first = False
        whole, met, text = text.rpartition(sep)
        if met:
            if borders:
                number += whole.count(sep) + 1
            else:
                lines = whole.split(sep)
                yield lines, number, WHOLE
                number += len(lines)
        open_parts, edge = [text], text[1 - len(sep) :] if len(sep) > 1 else b""
    yield [b"".join(open_parts)], -1 if first else number, MIDDLE if first else TAIL


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(file, split, what lies between first bytes) of a task's splits one after another."""
    columns = ([batch.column(n) for n in ("file", "block", "chunk")] for batch in batches)
    rows = (tuple(c[i].as_py() for c in three) for three in columns for i in range(len(three[0])))
    row = next(rows, None)

    def rest(file: str, block: int) -> Iterator[bytes]:
        nonlocal row
        while row is not None and row[:2] == (file, block):
            yield row[2]
            row = next(rows, None)

    while row is not None:
        file, block, chunk = row
        chunks = rest(file, block)
        if block == 0:  # nothing comes before the first member
            if chunk:
                raise ValueError(f"{file} is not block-gzip: its first bytes are others")
            next(chunks)
        yield file, block, chunks
        for _ in chunks:
            pass


def _lines(packed: DataFrame, sep: bytes, kinds: tuple[int, ...]) -> DataFrame:
    borders = WHOLE not in kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, chunks in _splits(batches):
            for pieces, number, kind in _pieces(_unpacked(chunks, file), sep, block == 0, borders):
                if kind in kinds:
                    n = len(pieces)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file] * n), pa.array([block] * n), pa.array(range(number, number + n), pa.int64()),
                            pa.array([kind] * n, pa.int32()), pa.array(pieces, pa.binary()),
                        ],
                        ["file", "block", "number", "kind", "value"],
                    )

    return packed.mapInArrow(run, "file string, block bigint, number bigint, kind int, value binary")


def _mended(borders: DataFrame, sep: str) -> DataFrame:
    """Lines that begin in one split and end in a later one (or with the file)."""
    order = Window.partitionBy("file").orderBy("block", "number")
    runs = borders.withColumn("line", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("block", "number", F.col("value").cast("string").alias("value"))))
    joined = runs.groupBy("file", "line").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "")
    # a separator may lie across the border
    lines = joined.select("file", "line", F.col("parts")[0].alias("at"), F.split(text, f"\\Q{sep}\\E", -1).alias("lines"))
    last = F.col("line") == F.max("line").over(Window.partitionBy("file"))
    size = F.size("lines")
    kept = F.when(last & (F.element_at("lines", -1) == ""), F.slice("lines", F.lit(1), size - 1)).otherwise(F.col("lines"))
    rows = lines.withColumn("lines", kept).select("file", "at", F.posexplode("lines").alias("place", "value"))
    return rows.select("file", F.col("at.block").alias("block"), (F.col("at.number") + F.col("place")).alias("number"), "value")


def read_packed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, block, chunk)``: what lies between the first bytes of members, in order within each split."""
    text = spark.read.option("lineSep", MAGIC.decode(ENCODING)).option("encoding", ENCODING).text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("chunk"),
    )


def packed_lines(packed: DataFrame, sep: str | None = None, whole_files: bool = False) -> DataFrame:
    """``(file, block, id, value)`` of ``read_packed``: ``id`` rises along the file, without gaps in a split, from 0 in the first.

    Lines end with a line break (a carriage return before it is dropped; one alone does not end a line) or ``sep``.
    A file's text is unpacked twice: once for the lines inside splits, once for the pieces at their borders, which
    there are none of if each file is one split (``whole_files``).
    """
    by = (sep or "\n").encode()
    lines = _lines(packed, by, (WHOLE, TAIL) if whole_files else (WHOLE,))
    if whole_files:  # nothing comes after the last separator of a file that ends with it
        lines = lines.where((F.col("kind") == WHOLE) | (F.octet_length("value") > 0))
    lines = lines.select("file", "block", "number", F.col("value").cast("string").alias("value"))
    if not whole_files:
        lines = lines.unionByName(_mended(_lines(packed, by, (HEAD, TAIL, MIDDLE)), sep or "\n"))
    value = F.regexp_replace("value", "\r$", "") if sep is None else F.col("value")
    return lines.select("file", "block", (F.col("block") * RATIO + F.col("number")).alias("id"), value.alias("value"))


def _member(text: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(text) + packer.flush()
    size = len(HEADER) + 2 + len(data) + 8
    tail = zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")
    return HEADER + (size - 1).to_bytes(2, "little") + data + tail


def write_packed(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes ``value`` as lines of block-gzip files, one a task, with the empty member at the end of each.

    Spark's text writer puts that empty member, which readers pass over, behind every row; a row holds the members of about one
    megabyte of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = b""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                values = batch.column("value").slice(at, 1024).to_pylist()
                held += b"".join(v + b"\n" for v in values)
                if len(held) >= BATCH_BYTES:
                    end = len(held) // MEMBER_BYTES * MEMBER_BYTES
                    yield packed_row(held[:end])
                    held = held[end:]
        if held:
            yield packed_row(held)

    def packed_row(text: bytes) -> pa.RecordBatch:
        members = b"".join(_member(text[i : i + MEMBER_BYTES]) for i in range(0, len(text), MEMBER_BYTES))
        return pa.RecordBatch.from_arrays([pa.array([members], pa.binary())], ["value"])

    rows = lines.select(F.coalesce(F.col("value"), F.lit("")).cast("binary").alias("value")).mapInArrow(run, "value binary")
    writer = rows.select(F.col("value").cast("string").alias("value")).write.mode(mode)
    writer.option("lineSep", EMPTY.decode(ENCODING)).option("encoding", ENCODING).text(path)
