"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandlens.operators.reads import trim_reads
from strandlens.sources.blockgzip import write_packed


OBSERVED_INPUTS = 256


def write_text(lines: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """``value`` as lines; ``compression`` is one of Spark's, or ``bgz`` for block-gzip, read with ``blocks=True``."""
    if compression in ("bgz", "bgzf"):
        write_packed(lines, path, mode)
    else:
        lines.write.mode(mode).text(path, compression=compression)


def write_fastq(reads: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """Reads as four-line records, absent sequences and qualities as empty lines; parts are written in parallel."""
    text = [F.coalesce(c, F.lit("")) for c in (F.concat(F.lit("@"), F.col("read_id")), F.col("seq"), F.lit("+"), F.col("qual"))]
    record = F.concat_ws("\n", *text)
    write_text(reads.select(record.alias("value")), path, mode, compression)


def filter_to_fastq(
    reads: DataFrame,
    path: str,
    inputs: Sequence[str] = (),
    *,
    inverse: bool = False,
    mode: str = "errorifexists",
    compression: str | None = None,
    **options,
) -> DataFrame:
    """Writes the reads that ``filter_trim`` keeps, and counts what came in and went out in the same pass.

    Returns ``(file, input_reads, output_reads, filtered_reads, output_bases)``: one row with a null ``file`` on all reads, and one for
    each of ``inputs``, values of the column ``file``, those without a read included. The counts are metrics that the tasks of the write observe, so
    nothing is read a second time; each input is a metric of its own, which is why there may be at most ``OBSERVED_INPUTS``.
    For more, ``filter_report`` groups by input.
    """
    if len(inputs) > OBSERVED_INPUTS:
        raise ValueError(f"at most {OBSERVED_INPUTS} inputs can be counted while writing, got {len(inputs)}")
    # a new column, so that the optimizer does not evaluate the condition again above the observation
    marked = trim_reads(reads, **options).withColumn("_kept", F.col("passed") != F.lit(inverse))
    cut = {c: F.col(c if inverse else f"trimmed_{c}") for c in ("seq", "qual")}
    metrics = []
    for i, name in enumerate((None, *inputs)):
        here = F.lit(True) if name is None else F.col("file") == F.lit(name)
        kept = here & F.col("_kept")
        bases = F.sum(F.when(kept, F.length(cut["seq"])).otherwise(0))
        metrics += [F.count_if(here).alias(f"in_{i}"), F.count_if(kept).alias(f"out_{i}"), F.coalesce(bases, F.lit(0)).alias(f"bases_{i}")]
    seen = Observation()
    observed = marked.observe(seen, *metrics)
    write_fastq(observed.where("_kept").select("read_id", *[c.alias(n) for n, c in cut.items()]), path, mode, compression)
    found = seen.get
    rows = [(n, found[f"in_{i}"], found[f"out_{i}"], found[f"in_{i}"] - found[f"out_{i}"], found[f"bases_{i}"]) for i, n in enumerate((None, *inputs))]
    return reads.sparkSession.createDataFrame(rows, "file string, input_reads bigint, output_reads bigint, filtered_reads bigint, output_bases bigint")


def write_bed(intervals: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Contig, start, end and, where there is one, the name."""
    columns = ["contig", "start", "end", *(["name"] if "name" in intervals.columns else [])]
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])
    intervals.select(line.alias("value")).write.mode(mode).text(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row; null stays apart from an empty list."""
    report.write.mode(mode).option("ignoreNullFields", "false").json(path)


def report_json(report: DataFrame) -> DataFrame:
    """The same objects as a text column ``value``."""
    return report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
