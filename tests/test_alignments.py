import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlens.functions import cigar as cg
from strandlens.operators import alignments as al
from strandlens.operators import depth as dp
from strandlens.operators import overlap as ov
from strandlens.plans import reports
from strandlens.plans.presets import preset
from strandlens.sources.headers import sam_header_lines, sam_references
from strandlens.sources.sam import read_sam

SCHEMA = """file string, qname string, flag int, contig string, pos bigint, mapq int, cigar string, rnext string, pnext bigint,
tlen bigint, seq string, qual string, tags map<string,string>"""


def high_depth_sam():
    lines = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chrHD\tLN:1000", "@RG\tID:rg1\tSM:highdepth"]
    for i in range(50):
        start = 1 + 10 * (i % 10)
        lines.append(f"r{i + 1}\t0\tchrHD\t{start}\t60\t100M\t*\t0\t0\t{'A' * 100}\t{'I' * 100}\tRG:Z:rg1\tNM:i:0\tMD:Z:100")
    return "\n".join(lines) + "\n"


def test_high_depth_sam(spark, write):
    path = write("h.sam", high_depth_sam())
    aln = read_sam(spark, path)
    refs = sam_references(sam_header_lines(spark, path)).select("file", F.col("name").alias("contig"), "length")
    got = reports.alignment_summary(aln, refs, include_error_profile=True, coverage_options={"low_cov_threshold": 6}).collect()[0]
    a, c, e = got.alignment, got.coverage, got.errors
    assert (a.total_reads, a.primary, a.mean_length, a.n50, a.mean_identity) == (50, 50, 100.0, 100, 100.0)
    assert c.mean_depth == 5.0 and c.median_depth == 0.0
    assert max(b.start for b in c.coverage_distribution) == 50
    assert sum(b["count"] for b in c.coverage_distribution if b.start > 0) == 190
    assert [(r.contig, r.start, r.end) for r in c.low_coverage_regions] == [("chrHD", 0, 1000)]
    assert e.mismatch_rate == 0 and len(e.mismatch_by_cycle) == 100
    assert aln.select(F.col("tags")["RG"]).distinct().collect()[0][0] == "rg1"


def random_alignments(n, seed, contigs=("c1", "c2"), span=3000):
    """Reads over a random genome, with cigar, MD and NM made from what was done to each read."""
    rng = random.Random(seed)
    rows, truth = [], []
    for i in range(n):
        ops, md, run, reads, blocks, nm, gaps = [], "", 0, [], [], 0, []
        pos = rng.randint(0, span)
        ref = pos
        if rng.random() < 0.3:
            ops.append((rng.randint(1, 4), "H"))
        at = rng.randint(1, 9) if rng.random() < 0.4 else 0
        if at:
            ops.append((at, "S"))
        query = at
        for j in range(rng.randint(1, 6)):
            size = rng.randint(1, 30)
            ops.append((size, rng.choice("M=X")))
            for k in range(size):
                if rng.random() < 0.1:
                    md, run, nm = md + f"{run}A", 0, nm + 1
                    reads.append(query + k)
                else:
                    run += 1
            if blocks and blocks[-1][1] == ref:
                blocks[-1] = (blocks[-1][0], ref + size)
            else:
                blocks.append((ref, ref + size))
            ref, query = ref + size, query + size
            gap, kind = rng.randint(1, 12), rng.choice("DNIX")
            if j < 5 and kind in "DNI":
                ops.append((gap, kind))
                if kind == "D":
                    md, run, nm = md + f"{run}^" + "C" * gap, 0, nm + gap
                    gaps.append((query, None))
                if kind == "I":
                    gaps += [(query + k + 1, query + k) for k in range(gap)]
                    query, nm = query + gap, nm + gap
                else:
                    ref += gap
        if rng.random() < 0.4:
            ops.append((5, "S"))
            query += 5
        md += str(run)
        flag = rng.choice([0, 0, 0, 16, 16, 4, 256, 512, 1024, 2048])
        contig = "c1" if rng.random() < 0.6 else rng.choice(contigs)
        cigar = "".join(f"{k}{o}" for k, o in ops)
        rows.append(
            (f"f{i % 2}", f"r{i}", flag, contig, pos, rng.randint(0, 60), cigar, "*", -1, 0, "A" * query, "I" * query, {"NM": str(nm), "MD": md})
        )
        cycles = [query - p if flag & 16 else p + 1 for p in reads]
        around = [(f if not flag & 16 else query - (f if b is None else b)) for f, b in gaps]
        truth.append((rows[-1], blocks, sorted(cycles), (ops, sorted(around))))
    return rows, truth


def test_cigar_functions_against_walk(spark):
    rows, truth = random_alignments(300, 5)
    rows += [("f0", "none", 4, "*", -1, 0, "*", "*", -1, 0, "*", "*", {}), ("f0", "null", 4, "*", None, 0, None, "*", -1, 0, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = df.select(
        "qname",
        cg.block_array(F.col("cigar"), F.col("pos")).alias("b"),
        cg.cigar_summary(F.col("cigar")).alias("s"),
        cg.mismatch_cycles(F.col("cigar"), al.tag("MD"), F.col("flag").bitwiseAND(16) != 0).alias("m"),
        cg.gap_cycles(F.col("cigar"), F.col("flag").bitwiseAND(16) != 0).alias("g"),
        cg.cigar_ops(F.col("cigar")).alias("ops"),
    )
    got = {r.qname: r for r in out.collect()}
    assert got["none"].b == [] and got["none"].m == [] and got["none"].s.aligned == 0 and got["null"].m == []
    for row, blocks, cycles, (ops, gaps) in truth:
        r = got[row[1]]
        assert [(b.start, b.end) for b in r.b] == blocks, row
        assert sorted(r.m) == cycles, row
        assert sorted(r.g) == gaps, row
        assert [(o.len, o.op) for o in r.ops] == ops

        def total(letters):
            return sum(k for k, o in ops if o in letters)

        assert (r.s.aligned, r.s.ins_bases, r.s.del_bases, r.s.skipped, r.s.soft_clip, r.s.ref_span) == (
            total("M=X"), total("I"), total("D"), total("N"), total("S"), total("M=XDN"),
        )


def per_base(truth, mask=1796, min_mapq=0):
    depth = Counter()
    for row, blocks, _, _ in truth:
        if not row[2] & mask and row[5] >= min_mapq:
            for s, e in blocks:
                depth.update((row[0], row[3], p) for p in range(s, e))
    return depth


@pytest.mark.parametrize("tile", [16, 100, 1 << 16])
def test_depth_and_targets_against_counting(spark, tile):
    rows, truth = random_alignments(400, 11, span=400)
    depth = per_base(truth, min_mapq=10)
    aln = spark.createDataFrame(rows, SCHEMA)
    blocks = dp.aligned_blocks(aln, min_mapq=10)
    runs = dp.base_depth(blocks, tile=tile).collect()
    assert {(r.file, r.contig, p): r.depth for r in runs for p in range(r.start, r.end)} == depth
    ends = {(r.file, r.contig, r.start): r.depth for r in runs}
    assert not [r for r in runs if ends.get((r.file, r.contig, r.end)) == r.depth], "neighbours of equal depth are joined"

    size = 900
    refs = spark.createDataFrame([(f, c, size) for f in ("f0", "f1") for c in ("c1", "c2", "c3")], "file string, contig string, length bigint")
    full = dp.base_depth(blocks, tile=tile, refs=refs).collect()
    covered = Counter()
    for r in full:
        covered[(r.file, r.contig)] += r.end - r.start
        assert all(depth[(r.file, r.contig, p)] == r.depth for p in range(r.start, r.end))
    assert all(covered[(f, c)] == size for f in ("f0", "f1") for c in ("c1", "c2", "c3"))

    rng = random.Random(2)
    regions = [(i, rng.choice(["c1", "c2", "c3"]), s, s + rng.randint(1, 200), f"n{i}") for i, s in enumerate(rng.choices(range(700), k=60))]
    regions += [(98, "c1", 10, 20, "first"), (99, "c1", 10, 20, "again"), (100, "c1", 5, 5, "empty")]
    bed = spark.createDataFrame(regions, "line_no bigint, contig string, start bigint, end bigint, name string")
    for limit in (0, 1000):
        out = reports.targeted_coverage_report(aln, bed, min_mapq=10, tile=tile, bin_size=32, broadcast_rows=limit).collect()
        assert len(out) == 2 * len({r[1:4] for r in regions})
        empty = [r for r in out if r.start == r.end]
        assert len(empty) == 2 and all((r.mean_depth, r.min_depth, r.max_depth, r.pct_coverage_1x) == (None, 0, 0, None) for r in empty)
        for r in (r for r in out if r.start < r.end):
            values = [depth[(r.file, r.contig, p)] for p in range(r.start, r.end)]
            assert r.mean_depth == pytest.approx(sum(values) / len(values))
            assert (r.min_depth, r.max_depth) == (min(values), max(values))
            assert r.pct_coverage_10x == pytest.approx(100 * sum(v >= 10 for v in values) / len(values))
        assert {r.region_name for r in out if (r.contig, r.start, r.end) == ("c1", 10, 20)} == {"again"}
    joins = [ov.overlap_join(blocks, bed, bin_size=32, broadcast_rows=n, left_salts=k) for n, k in ((0, 1), (0, 3), (150, 2), (1000, 1))]
    want = sum(
        not row[2] & 1796 and row[5] >= 10 and row[3] == c and s < e2 and s2 < e
        for row, bs, _, _ in truth for s, e in bs for _, c, s2, e2, _ in regions if s2 < e2
    )
    assert [j.where("r_start < r_end").count() for j in joins] == [want] * 4


def test_full_bins_are_split(spark, monkeypatch):
    monkeypatch.setattr(ov, "ROWS_PER_SALT", 10)
    left = spark.range(40).selectExpr("'c' contig", "id start", "id + 5 end").repartition(4)
    right = spark.range(300).selectExpr("'c' contig", "id % 50 start", "id % 50 + 1 + id % 3 end", "id n")
    want = sum(s < b % 50 + 1 + b % 3 and b % 50 < s + 5 for s in range(40) for b in range(300))
    for rows, salts in ((0, 1), (0, 4), (2, 4)):
        pairs = ov.overlap_join(left, right, bin_size=64, broadcast_rows=rows, left_salts=salts)
        assert pairs.columns == ["contig", "start", "end", "r_start", "r_end", "n"]
        assert pairs.count() == want


def random_intervals(rng, n, longest):
    """Most of them short, some as long as a contig, some below 0."""
    spans = []
    for i in range(n):
        s = rng.randint(-20, 5000)
        spans.append((rng.choice(["c1", "c2"]), s, s + (rng.randint(1, longest) if i % 9 else rng.randint(1, 100_000)), i))
    return spans


@pytest.mark.parametrize("rows,salts,count", [(0, 1, False), (0, 3, False), (0, 1, True), (10**6, 1, False)])
def test_overlaps_of_any_length(spark, monkeypatch, rows, salts, count):
    monkeypatch.setattr(ov, "ROWS_PER_SALT", 20)
    rng = random.Random(rows + salts)
    a, b = random_intervals(rng, 150, 40), random_intervals(rng, 120, 600)
    left = spark.createDataFrame(a, "contig string, start bigint, end bigint, i bigint").repartition(3)
    right = spark.createDataFrame(b, "contig string, start bigint, end bigint, j bigint")
    want = sorted((i, j) for c, s, e, i in a for c2, s2, e2, j in b if c == c2 and s < e2 and s2 < e)
    pairs = ov.overlap_join(left, right, bin_size=16, broadcast_rows=rows, left_salts=salts, count_left=count)
    assert sorted((r.i, r.j) for r in pairs.collect()) == want
    assert ov.overlap_join(left, right.limit(0), bin_size=16).isEmpty() and ov.overlap_join(left.limit(0), right, bin_size=16).isEmpty()

@pytest.mark.parametrize("tile", [4, 64, 1 << 16])
def test_overlap_sums_are_those_of_all_pairs(spark, tile):
    rng = random.Random(tile)
    a = [(c, s, max(s, e)) for c, s, e, _ in random_intervals(rng, 300, 60)] + [("c1", 5, 5), ("c1", 9, 9), (None, 1, 9), ("c2", None, 4)]
    b = random_intervals(rng, 200, 400) + [("c1", 5, 5, -1), ("c1", 9, 2, -2), ("c1", 9, 2, -3), (None, 0, 99, -4), ("c2", 0, None, -5)]
    left = spark.createDataFrame(a * 3, "contig string, start bigint, end bigint").repartition(3)
    right = spark.createDataFrame(b, "contig string, start bigint, end bigint, j bigint")
    whole = [(*x, *y) for x in a * 3 for y in b if None not in (*x, *y) and x[0] == y[0]]
    want = {}
    for _, s, e, _, s2, e2, j in whole:
        if s < e2 and s2 < e:
            n, bases = want.get(j, (0, 0))
            want[j] = n + 1, bases + min(e, e2) - max(s, s2)
    got = {r.j: (r.overlaps, r.bases) for r in ov.overlap_sums(left, right, tile=tile, bin_size=16).collect()}
    assert got == want
    with pytest.raises(Exception, match="ends before it starts"):
        ov.overlap_sums(spark.createDataFrame([("c1", 9, 2)], left.schema), right).collect()


def test_sums_by_region_form_no_pairs(spark, monkeypatch):
    """Blocks and regions pile up on the same few bases as tables grow, so their pairs grow with the product."""
    from workload.edges import _sums_by_line

    monkeypatch.setattr(ov, "overlap_join", None)
    blocks = spark.range(20_000).selectExpr("'c1' contig", "id % 7 start", "id % 7 + 50 end")
    regions = spark.range(20_000).selectExpr("'c1' contig", "id line_no", "id % 5 + 10 start", "id % 5 + 20 end")
    sums = _sums_by_line(blocks, regions).agg(F.count("*"), F.sum("blocks"), F.sum("bases")).first()
    assert tuple(sums) == (20_000, 20_000**2, 10 * 20_000**2)


def test_a_long_region_is_one_row(spark):
    """A region of 250 million bases is filed once; an interval looks at the levels in use only."""
    right = spark.createDataFrame([("c1", 0, 250_000_000), ("c1", 70, 90)], "contig string, r_start bigint, r_end bigint")
    assert sorted(r._level for r in ov._filed(right, 1 << 14, 0).collect()) == [0, 5]
    left = spark.createDataFrame([("c1", 100, 200), ("c1", 0, 10**9)], "contig string, start bigint, end bigint")
    assert sorted((r.start, r._of, r._level) for r in ov._probes(left, 1 << 14, [0, 5], 6).collect()) == [(0, 1, 6), (100, 0, 0), (100, 0, 5)]


def test_regions_for_many_inputs(spark, monkeypatch):
    monkeypatch.setattr(ov, "INPUTS_PER_BLOCK", 4)
    inputs = spark.createDataFrame([(f"f{i}",) for i in range(21)] * 2, "file string")
    spans = spark.createDataFrame([("c1", i) for i in range(9)], "contig string, start bigint")
    every = ov._per_input(spans, inputs, ["file"])
    assert every.columns == ["file", "contig", "start"] and every.count() == every.distinct().count() == 21 * 9


def test_pooled_inputs(spark):
    rows, truth = random_alignments(50, 4, span=100)
    blocks = dp.aligned_blocks(spark.createDataFrame(rows, SCHEMA), by=())
    bed = spark.createDataFrame([(1, "c1", 0, 50, None)], "line_no bigint, contig string, start bigint, end bigint, name string")
    got = ov.targeted_coverage(blocks, bed, by=()).collect()[0]
    depth = per_base(truth)
    assert got.mean_depth == pytest.approx(sum(n for (_, c, p), n in depth.items() if c == "c1" and p < 50) / 50)


def test_error_rates_and_identity(spark):
    rows = [
        ("f", "a", 0, "c", 0, 9, "10M2I5M3D5M", "*", -1, 0, "*", "*", {"NM": "7", "MD": "1A13^AAA4T0"}),
        ("f", "b", 0, "c", 0, 9, "10M", "*", -1, 0, "*", "*", {"NM": "0", "de": "0.25"}),
        ("f", "c", 256, "c", 0, 9, "10M", "*", -1, 0, "*", "*", {"NM": "10"}),
        ("f", "d", 0, "c", 0, 9, "10M", "*", -1, 0, "*", "*", {}),
    ]
    df = spark.createDataFrame(rows, SCHEMA).orderBy("qname")
    r = al.error_rates(df).collect()[0]
    assert (r.mismatch_rate, r.insertion_rate, r.deletion_rate) == pytest.approx((2 / 32, 2 / 32, 3 / 32))
    identity = [r.i for r in al.alignment_measures(df.coalesce(1)).select(F.col("identity").alias("i")).collect()]
    assert identity[3] is None and identity[:3] == pytest.approx([100 * (1 - 4 / 22), 75.0, 0.0])


def test_reads_from_alignments(spark):
    rows = [("f", n, flag, "c", 0, 9, "4M", "*", -1, 0, "AACG", "!I5+", {}) for n, flag in (("a", 0), ("b", 16), ("c", 256), ("d", 2048), ("e", 4))]
    got = {r.read_id: (r.seq, r.qual) for r in al.reads_from_alignments(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": ("AACG", "!I5+"), "b": ("CGTT", "+5I!"), "e": ("AACG", "!I5+")}


def test_coverage_summary_golden(spark):
    rows = [("f", "chr1", 1000, 10.0), ("f", "chr2", 500, 5.0), ("g", "x", 0, 3.0), ("g", "y", 0, 5.0)]
    contigs = spark.createDataFrame(rows, "file string, contig string, length bigint, mean_depth double")
    got = {r.file: (r.mean_depth, r.mean_depth_unweighted) for r in dp.coverage_summary(contigs).collect()}
    assert got["f"] == (pytest.approx(25 / 3), 7.5) and got["g"] == (4.0, 4.0)
    assert [r.contig for r in dp.low_coverage(contigs, 5).collect()] == ["x"]
    assert dp.low_coverage(contigs, None).count() == 0


def test_target_modes(spark):
    with pytest.raises(ValueError, match="One of"):
        reports.target_regions(spark)
    with pytest.raises(ValueError, match="Only one"):
        reports.target_regions(spark, gene="a", location="c:1-2")
    with pytest.raises(ValueError, match="features"):
        reports.target_regions(spark, gene="a")
    got = reports.target_regions(spark, location="c1:10-20:mine").collect()[0]
    assert (got.contig, got.start, got.end, got.name) == ("c1", 10, 20, "c1:10-20:mine")
    assert reports.target_regions(spark, location="c1:10-20", one_based=True).collect()[0].start == 9


def test_region_lists_and_coverage_tables(spark):
    a, b = (reports.target_regions(spark, location=x) for x in ("c1:0-10:a", "c1:0-10:b"))
    rows, truth = random_alignments(60, 8, span=100)
    aln = spark.createDataFrame(rows, SCHEMA)
    out = reports.targeted_coverage_report(aln, reports.combine_regions(a, b)).collect()
    assert {r.region_name for r in out} == {"c1:0-10:b"} and len(out) == 2
    with pytest.raises(ValueError):
        reports.combine_regions()
    refs = spark.createDataFrame([("f0", "c1", 1005)], "file string, contig string, length bigint")
    tables = reports.coverage_tables(aln, refs, **preset("coverage_tables", "window_1kb"))
    assert [(r.start, r.end) for r in tables["windows"].orderBy("start").collect()] == [(0, 1000), (1000, 1005)]
    runs = reports.coverage_tables(aln, refs, **preset("coverage_tables", "fast_quantized"))["quantized"]
    assert sum(r.end - r.start for r in runs.where("contig = 'c1' and file = 'f0'").collect()) == 1005
    report = reports.alignment_report(aln, **preset("alignment_report", "with_flags_and_mapq")).orderBy("file").collect()[0]
    mine = [t[0] for t in truth if t[0][0] == "f0"]
    assert {int(b.start): b["count"] for b in report.flag_histogram} == Counter(r[2] for r in mine)
    assert sum(b["count"] for b in report.mapq_histogram) == sum(not r[2] & 260 for r in mine)
    assert report.length_histogram_scaled is None
    scaled = reports.alignment_report(aln, **preset("alignment_report", "with_hist_scaled")).orderBy("file").collect()[0]
    assert sum(b["count"] for b in scaled.length_histogram_scaled) == sum(b["count"] for b in scaled.mapq_histogram_scaled)
    with pytest.raises(ValueError, match="window"):
        dp.window_coverage(dp.aligned_blocks(aln), refs, 0)


def test_one_deep_spot_keeps_tiles_small(spark):
    """All reads at one place: the sweep sees each border once."""
    blocks = spark.range(200_000).select(F.lit("f").alias("file"), F.lit("c").alias("contig"), (F.col("id") % 3).alias("start"), F.lit(50).cast("bigint").alias("end"))
    got = [(r.start, r.end, r.depth) for r in dp.base_depth(blocks).orderBy("start").collect()]
    assert got == [(0, 1, 66667), (1, 2, 133334), (2, 50, 200000)]


def test_malformed_sam_fields_are_null(spark, write):
    text = "r\tx\tc\t0\ty\t*\t*\t0\t0\t*\t*\tAB:Z:a:b\n"
    r = read_sam(spark, write("m.sam", text)).collect()[0]
    assert (r.flag, r.mapq, r.pos, r.tags) == (None, None, -1, {"AB": "a:b"})
    assert re.match("file:/", r.file)


def test_means_of_contigs_come_from_the_sweep(spark, monkeypatch, capsys):
    """A coverage report walks the cigars once, and a summary shares that walk between its sweeps."""
    from workload import views

    aln, refs = views.alignments(spark, "/root/testdata/sf0.001"), views.references(spark, "/root/testdata/sf0.001")
    fields = "file", F.transform("coverage_by_contig", lambda c: F.struct(c["contig"], c["length"], c["mean_depth"]))
    plain = sorted(reports.coverage_report(aln, refs, with_distribution=False).select(*fields).collect())
    monkeypatch.setattr(dp, "coverage_by_contig", None)
    swept = reports.coverage_report(aln, refs, tile=256)
    assert sorted(swept.select(*fields).collect()) == plain
    assert len(plain) == 2
    blocks = dp.aligned_blocks(aln)
    hist = dp.depth_histogram(dp.base_depth(blocks, refs=refs, merge=False)).unionByName(dp.depth_histogram(dp.base_depth(blocks, merge=False)))
    hist.collect()
    hist.explain()
    assert "ReusedExchange" in capsys.readouterr().out
