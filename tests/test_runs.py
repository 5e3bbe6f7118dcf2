import pytest
from pyspark.sql import functions as F

from strandlens.operators.runs import run_stats, yield_per_hour
from strandlens.plans.reports import run_report
from strandlens.sources.runlog import read_sequencing_summary, resolve_column

HEADER = "filename\tread_id\trun_id\tchannel\tstart_time\tsequence_length_template\tmean_qscore_template\n"


def log(rows):
    return HEADER + "".join(f"f\tr{i}\trun\t{c}\t{t}\t{n}\t{q}\n" for i, (c, t, n, q) in enumerate(rows))


def stats(spark, path):
    return run_stats(read_sequencing_summary(spark, path)).collect()[0]


def test_three_reads(spark, write):
    path = write("s.txt", log([(115, 1.80, 19024, 9.71), (143, 53.03, 45348, 13.18), (90, 42.52, 3082, 8.21)]))
    got = stats(spark, path)
    assert (got.total_yield, got.total_reads, got.n50, got.active_channels) == (67454, 3, 45348, 3)
    assert got.mean_length == pytest.approx(67454 / 3)
    assert got.mean_qscore == pytest.approx(31.10 / 3)


def test_bad_start_time_keeps_lengths_with_their_read(spark, write):
    runs = read_sequencing_summary(spark, write("s.tsv", log([(1, "bad", 9999, 10), (1, "0.0", 1000, 10), (1, "7200.0", 2000, 10)])))
    got = {r.window_start_hours: r.yield_bp for r in yield_per_hour(runs).collect()}
    assert got == {0.0: 1000, 2.0: 2000}
    assert run_stats(runs).collect()[0].run_duration_hours == 2.0


def test_equal_times_have_no_windows(spark, write):
    runs = read_sequencing_summary(spark, write("s.tsv", log([(1, 5.0, 100, 10), (2, 5.0, 200, "x")])))
    got = run_report(runs).collect()[0]
    assert got.yield_per_hour == [] and got.run_duration_hours == 0.0 and got.mean_qscore == 10.0


def test_decoy_columns(spark, write):
    text = "template_duration_time\tmeasurement_length\tread_quality\tstart_time\tSEQUENCE_LENGTH_TEMPLATE\n9\t1\t12.0\t0\t1500\n9\t1\t12.0\t3600\t3000\n"
    got = stats(spark, write("s.txt", text))
    assert (got.total_yield, got.mean_qscore, got.run_duration_hours, got.active_channels) == (4500, 12.0, 1.0, None)


def test_layouts_load_together_and_bad_rows_drop(spark, write, tmp_path):
    write("a.txt", "channel\tread length\n 7 \t10\nx\t20\n\n7\t3.0\n7\n")
    write("b.txt", "length\tstart_time_utc\n5\t0\n")
    runs = read_sequencing_summary(spark, str(tmp_path))
    rows = sorted((r.length, r.channel, r.start_time) for r in runs.collect())
    assert rows == [(5, None, 0.0), (10, 7, None), (20, None, None)]


def test_file_without_reads_counts_zero(spark, write):
    runs = read_sequencing_summary(spark, write("s.txt", HEADER))
    files = spark.createDataFrame([("empty",)], "file string")
    got = run_stats(runs, files=files).collect()[0]
    assert (got.total_yield, got.total_reads, got.n50) == (0, 0, None)


def test_missing_length_column(spark, write):
    with pytest.raises(Exception, match="sequence_length_template"):
        read_sequencing_summary(spark, write("s.txt", "channel\tstart_time\n1\t2\n")).collect()


def test_many_splits_number_rows(spark, write):
    path = write("s.txt", log([(1, i, 100 + i, 9) for i in range(500)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = read_sequencing_summary(spark, path).orderBy("row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.row for r in rows] == list(range(2, 502))
    assert [r.length for r in rows] == [100 + i for i in range(500)]


@pytest.mark.parametrize(
    "names, place",
    [("a length_x length", 1), ("sequence_length length sequence_length_template", 2), ("length x length", 2), ("a b", None)],
)
def test_resolve_column(spark, names, place):
    columns = F.array(*[F.lit(n) for n in names.split()])
    exact, parts = ("sequence_length_template",), ("sequence_length", "length")
    assert spark.range(1).select(resolve_column(columns, exact, parts)).collect()[0][0] == place


def test_null_labels_are_kept(spark):
    runs = spark.createDataFrame(
        [(None, 10, 0.0, 1.0, 1), (None, 30, 7200.0, 3.0, 2), ("a", 5, 0.0, 9.0, 1)],
        "file string, length bigint, start_time double, qscore double, channel bigint",
    )
    got = {r.file: (r.total_yield, r.n50, r.mean_qscore) for r in run_stats(runs).collect()}
    assert got == {None: (40, 30, 2.0), "a": (5, 5, 9.0)}
    assert yield_per_hour(runs).count() == 2
