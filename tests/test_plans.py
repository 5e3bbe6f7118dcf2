"""Shapes of plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandlens.operators import alignments as al
from strandlens.operators import depth as dp
from strandlens.operators import overlap as ov
from strandlens.operators import reads as rd
from strandlens.sources import sinks
from strandlens.sources.fastq import read_fastq
from workload import views

SF = "/root/testdata/sf0.001"


def final_plan(df):
    """The nodes that ran, those of subqueries included; adaptive plans by their final stages only."""
    df.collect()
    lines = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        lines.append(node.simpleString(10_000))
        if name.endswith("QueryStage"):
            return walk(node.plan())
        for group in (node.children(), node.subqueries()):
            for i in range(group.size()):
                walk(group.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return "\n".join(lines)


@pytest.mark.parametrize(
    "name", ["n50", "run_stats", "yield_per_hour", "read_stats", "alignment_stats", "mismatch_by_cycle", "read_length_distribution"]
)
def test_one_scan(spark, name):
    plan = final_plan(entry.queries()[name](spark, SF))
    assert plan.count("FileScan") == 1, plan
    assert "ReusedExchange" in plan


def test_columns_reach_the_scan(spark):
    plan = final_plan(entry.queries()["length_histogram"](spark, SF))
    assert "ReadSchema: struct<source:string,n_chars:bigint>" in plan
    plan = final_plan(entry.queries()["region_filter"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*p_brand", plan)


@pytest.mark.parametrize("name", ["targeted_coverage", "targeted_coverage_shuffled", "overlap_by_region", "overlap_whole_contigs", "gene_exons", "coverage_by_contig", "yield_per_hour"])
def test_no_nested_loops(spark, name):
    plan = final_plan(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_large_region_list_is_not_broadcast(spark):
    blocks = dp.aligned_blocks(views.alignments(spark, SF))
    pairs = ov.overlap_join(blocks, views.regions(spark, SF), bin_size=64, broadcast_rows=10)
    assert "ResolvedHint" not in pairs._jdf.queryExecution().analyzed().toString()
    small = ov.overlap_join(blocks, views.regions(spark, SF), bin_size=64, broadcast_rows=10**6)
    assert "ResolvedHint (strategy=broadcast)" in small._jdf.queryExecution().analyzed().toString()


def test_whole_fastq_records_are_not_shuffled(spark, write):
    reads = read_fastq(spark, write("a.fastq", "@a\nAC\n+\nII\n" * 50))
    plan = reads._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"(?<!Broadcast)Exchange (\w+)\(([^,]+), ([^,)]+)", plan)
    assert exchanges and all(kind == "hashpartitioning" and first.startswith("file") for kind, first, _ in exchanges)
    whole = plan[: plan.index("\n", plan.index("FileScan"))]
    assert "Exchange" not in whole.split("Union", 1)[1]


def test_quality_filter_is_evaluated_once(spark):
    reads = views.reads(spark, SF)
    plan = final_plan(rd.filter_trim(reads, quality=10, headcrop=5).select(F.md5("seq").alias("s"), F.md5("qual").alias("q")))
    assert len(re.findall("ArrowEvalPython", plan)) == 1


def test_error_report_walks_cigars_once(spark):
    """Rates and both cycle tables read one shuffle of the tally."""
    counts = al.error_tally(views.alignments(spark, SF))
    both = al.cycles_of_tally(counts).unionByName(al.cycles_of_tally(counts, with_gaps=True))
    plan = final_plan(both.join(al.error_rates_of_tally(counts), "file"))
    assert len(re.findall(r"MapInArrow", plan)) == 1 and "ReusedExchange" in plan


def test_counts_of_a_write_need_no_second_pass(spark, tmp_path):
    """The jobs of the write read each row of the table once."""
    reads = views.reads(spark, SF).withColumn("rec", F.lit(1))
    spark.sparkContext.setJobGroup("written", "written")
    try:
        counts = sinks.filter_to_fastq(reads, str(tmp_path / "out"), ["src1", "none"], quality=10, headcrop=5, minlength=100)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup("written") for s in tracker.getJobInfo(job).stageIds}
    assert sum(store.lastStageAttempt(s).inputRecords() for s in stages) == reads.count()
    want = {r.file: r for r in rd.filter_report(reads, quality=10, headcrop=5, minlength=100).collect()}
    got = {r.file: r for r in counts.collect()}
    assert tuple(got["src1"])[1:4] == tuple(want["src1"])[1:4] and got["none"].input_reads == 0
    assert got[None].input_reads == sum(r.input_reads for r in want.values())
    assert got[None].output_reads == sum(r.output_reads for r in want.values()) == read_fastq(spark, str(tmp_path / "out"), check_names=False).count()
    inverse = sinks.filter_to_fastq(reads, str(tmp_path / "rest"), inverse=True, quality=10, headcrop=5, minlength=100).collect()[0]
    assert inverse.output_reads == got[None].filtered_reads
    with pytest.raises(ValueError, match="at most"):
        sinks.filter_to_fastq(reads, str(tmp_path / "many"), [str(i) for i in range(257)])
