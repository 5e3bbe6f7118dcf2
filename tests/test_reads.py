import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from strandlens.functions import reads as fn
from strandlens.operators import distribution as ds
from strandlens.operators import reads as rd
from strandlens.plans.presets import PRESETS, apply_read_preset, preset
from strandlens.plans.reports import qscore_distribution, read_report
from strandlens.sources.fastq import read_fastq
from strandlens.sources.sinks import report_json, write_fastq


def make_reads(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randint(1, 60)
        qual = "".join(rng.choice("@+!5I~") for _ in range(size))
        rows.append((f"r{i} x=@{i}", "".join(rng.choice("ACGTN") for _ in range(size)), qual))
    return rows


def fastq(rows, sep="\n"):
    return "".join(f"@{i}{sep}{s}{sep}+{sep}{q}{sep}" for i, s, q in rows)


def load(spark, path):
    return sorted((r.read_id, r.seq, r.qual) for r in read_fastq(spark, path).collect())


@pytest.mark.parametrize("split", [64, 200, 1000, 1 << 27])
def test_fastq_over_splits(spark, write, split):
    rows = make_reads(400)
    path = write("a.fastq", fastq(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        assert load(spark, path) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fastq_gzip_members_crlf_and_no_last_newline(spark, tmp_path):
    a, b, c, d = (make_reads(50, s) for s in range(4))
    (tmp_path / "a.fq.gz").write_bytes(gzip.compress(fastq(a).encode()) + gzip.compress(fastq(b).encode()))
    (tmp_path / "c.fq").write_bytes(fastq(c, "\r\n").encode())
    (tmp_path / "d.fastq").write_text(fastq(d)[:-1])
    assert load(spark, str(tmp_path)) == sorted(a + b + c + d)
    assert read_fastq(spark, str(tmp_path), tasks=5).count() == 200


def test_fastq_odd_records(spark, write):
    rows = [("e", "", ""), ("one", "A", "@"), ("two", "AC", "@@"), ("p", "A", "+"), ("last", "ACG", "@+@")]
    assert load(spark, write("o.fastq", fastq(rows))) == sorted(rows)


@pytest.mark.parametrize("text", ["@a\nAC\n+\nII\n@b\nAC\n+\n", "@a\nAC\n+\nI\n", "@a\nAC\n"])
def test_broken_fastq(spark, write, text):
    with pytest.raises(Exception, match="Broken FASTQ|differ in length"):
        read_fastq(spark, write("b.fastq", text)).collect()


def test_write_fastq(spark, tmp_path):
    rows = make_reads(30)
    df = spark.createDataFrame([(f"f{i % 3}", *r) for i, r in enumerate(rows)], "file string, read_id string, seq string, qual string")
    write_fastq(df, str(tmp_path / "out"))
    back = read_fastq(spark, str(tmp_path / "out"), check_names=False)
    assert sorted((r.read_id, r.seq, r.qual) for r in back.collect()) == sorted(rows)


def test_uniform_reads(spark):
    df = spark.createDataFrame([("f", "ACGT" * 25, "I" * 100)] * 100, "file string, seq string, qual string")
    got = rd.read_stats(df).collect()[0]
    assert (got.read_count, got.total_bases, got.min_len, got.max_len, got.n50) == (100, 10000, 100, 100, 100)
    assert got.mean_qscore == pytest.approx(40) and got.median_qscore == pytest.approx(40) and got.gc_content == 0.5


def test_mean_qscore_of_any_text(spark):
    quals = ["!", "~", "", None, "5I!+", "I" * 10000]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(quals)], "i int, qual string").coalesce(1)
    got = {r.i: r.q for r in df.select("i", fn.mean_qscore(F.col("qual")).alias("q")).collect()}
    for i, q in enumerate(quals):
        if not q:
            assert got[i] is None
        else:
            want = -10 * math.log10(sum(10 ** (-(ord(c) - 33) / 10) for c in q) / len(q))
            assert got[i] == pytest.approx(want, abs=1e-9)


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    lo = int(at)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] * (1 - (at - lo)) + values[hi] * (at - lo)


@pytest.mark.parametrize("width", [0.5, 7.0, 1e9])
def test_order_statistics_against_sorting(spark, width):
    rng = random.Random(3)
    data = {"hot": [rng.choice([5, 5, 5, rng.randint(0, 5000)]) for _ in range(3000)], "one": [7], "zero": [0, 0]}
    rows = [(f, float(v)) for f, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "file string, v double")
    probs = (0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0)
    out = ds.order_statistics(ds.tally(df, {"m": F.col("v")}), probs=probs, widths={"m": width}).collect()
    assert len(out) == 3
    for r in out:
        vs = data[r.file]
        assert r.quantiles == pytest.approx([quantile(vs, p) for p in probs])
        total, n50 = 0, None
        for v in sorted(vs, reverse=True):
            total += v
            if total >= sum(vs) / 2:
                n50 = v
                break
        assert (r.nx, r.n, r.distinct, r.total) == (n50, len(vs), len(set(vs)), sum(vs))


def test_histograms(spark):
    df = spark.createDataFrame([("f", v) for v in (1.0, 2.0, 3.0, 4.0, 5.0)], "file string, v double")
    bins = ds.histogram(df, "v", 2).orderBy("start").collect()
    assert [(b.start, b.end, b["count"]) for b in bins] == [(0, 2, 1), (2, 4, 2), (4, 6, 2)]
    assert ds.length_percentiles(df.withColumn("length", F.col("v"))).collect()[0].p50 == 3.0
    many = spark.range(200_001).select(F.lit("f").alias("file"), F.col("id").alias("length"))
    assert ds.length_percentiles(many).collect()[0].p50 == 100_000
    q = spark.createDataFrame([("f", v) for v in (0.0, 0.1, 1.9, 2.0, float("nan"), float("inf"), None)], "file string, qscore double")
    assert [b["count"] for b in ds.qscore_histogram(q).orderBy("start").collect()] == [2, 1, 1]
    gap = spark.createDataFrame([("f", 9.0), ("f", -1.0)], "file string, v double")
    assert [b["count"] for b in ds.histogram(gap, "v", 4).orderBy("start").collect()] == [1, 0, 1]
    with pytest.raises(ValueError):
        ds.histogram(df, "v", 0)


def test_filter_and_trim(spark):
    rows = [("f", "short", "ACGT", "IIII"), ("f", "good", "A" * 20, "!" * 3 + "I" * 15 + "!!"), ("f", "bad", "A" * 20, "!" * 20)]
    df = spark.createDataFrame(rows, "file string, read_id string, seq string, qual string")
    kept = rd.filter_trim(df, cutoff=20, trim_approach="trim-by-quality", minlength=10).collect()
    assert [(r.read_id, len(r.seq), r.qual) for r in kept] == [("good", 15, "I" * 15)]
    assert {r.read_id for r in rd.filter_trim(df, headcrop=2, tailcrop=1, minlength=10).collect()} == {"good", "bad"}
    assert [len(r.seq) for r in rd.filter_trim(df, headcrop=2, tailcrop=1, minlength=1).collect()] == [1, 17, 17]
    inverse = rd.filter_trim(df, headcrop=2, tailcrop=1, minlength=10, inverse=True).collect()
    assert [(r.read_id, r.seq) for r in inverse] == [("short", "ACGT")]
    assert rd.filter_trim(df, headcrop=30).count() == 0
    report = rd.filter_report(df, minlength=10).collect()[0]
    assert (report.input_reads, report.output_reads, report.filtered_reads) == (3, 2, 1)
    report = rd.filter_report(df, minlength=10, inverse=True).collect()[0]
    assert (report.output_reads, report.filtered_reads) == (1, 2)
    assert rd.filter_trim(df, quality=20).count() == 1


@pytest.mark.parametrize(
    "options",
    [{"headcrop": -1}, {"minlength": "5"}, {"trim_approach": "nearest"}, {"trim_approach": "trim-by-quality"}, {"quality": "x"}, {"headcrop": True}],
)
def test_wrong_options(spark, options):
    df = spark.createDataFrame([("a", "b")], "seq string, qual string")
    with pytest.raises(ValueError):
        rd.trim_reads(df, **options)


def test_presets(spark):
    df = spark.createDataFrame([("f", "r", "A" * 1500, "I" * 1500), ("f", "s", "A" * 300, "I" * 300)], "file string, read_id string, seq string, qual string")
    counts = {n: apply_read_preset(df, n).count() for t in ("filter_reads", "filter_trim") for n in PRESETS[t]}
    assert counts == {"strict_qc": 1, "lenient_qc": 2, "aggressive_trim": 1, "qual_trim": 2, "inverse_short_reads": 1}
    with pytest.raises(ValueError):
        preset("filter_reads", "none")
    with pytest.raises(ValueError):
        apply_read_preset(df, "none")


def test_report_and_positions(spark):
    df = spark.createDataFrame([("f", "ACG", "!I5"), ("f", "AC", "II")], "file string, seq string, qual string")
    report = read_report(df, length_bin=2).collect()[0]
    assert report.length_percentiles.p50 == 2.5
    assert [(b.start, b["count"]) for b in report.length_histogram] == [(0.0, 0), (2.0, 2)]
    assert sum(b["count"] for b in report.qscore_histogram) == 2
    positions = qscore_distribution(df, per_position=True).collect()[0].per_position_mean
    assert positions == pytest.approx([20.0, 40.0, 20.0])
    assert '"per_position_mean":null' in report_json(qscore_distribution(df)).collect()[0].value
