import pytest
from pyspark.sql import functions as F

from strandlens.functions import regions as rg
from strandlens.functions import text as tx
from strandlens.functions import variants as vf
from strandlens.operators import genes
from strandlens.operators import headers as hd
from strandlens.operators import intervals as iv
from strandlens.operators import variants as vr
from strandlens.plans.reports import target_regions, variant_report
from strandlens.sources import intervals as src
from strandlens.sources.headers import vcf_header_lines, vcf_references, vcf_samples
from strandlens.sources.vcf import read_vcf

VALID = "".join(f"ctgB\t{s}\t{e}\tspan{s}\t.\t-\n" for s, e in [(40, 90), (130, 131), (200, 460), (700, 705), (900, 1300)])
INVALID = (
    "ctgB\t40\t90\tgood\t.\t-\nctgB\t812\t377\tbackwards\t.\t-\nctgB\tseven\t60\tletters\t.\t-\n"
    "ctgB\t15\t?\tsign\t.\t+\nctgB\t900\t1300\tgood again\t.\t-\n"
)


def qc(spark, path, files=None):
    return iv.bed_qc(src.read_bed_lines(spark, path), files=files).collect()


def test_valid_bed(spark, write):
    r = qc(spark, write("v.bed", VALID))[0]
    assert (r.total_intervals, r.valid_intervals, r.total_bases, r.is_valid) == (5, 5, 716, True)


def test_invalid_bed(spark, write):
    path = write("i.bed", "# remark\ntrack x\nbrowser y\n\n" + INVALID + "chr1\t5\n")
    r = qc(spark, path)[0]
    assert (r.total_intervals, r.valid_intervals, r.total_bases, r.is_valid) == (6, 2, 450, False)
    issues = {i.line_number: i.issue for i in iv.bed_issues(src.read_bed_lines(spark, path)).collect()}
    assert issues == {
        6: "start 812 is not below end 377",
        7: "start is no whole number: seven",
        8: "end is no whole number: ?",
        10: "needs contig, start and end",
    }


def test_line_numbers_over_splits(spark, write):
    path = write("n.bed", "".join(f"c\t{i}\t{i + 1}\n" if i % 7 else "bad\n" for i in range(1, 800)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        lines = src.read_bed_lines(spark, path).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line_no for r in lines] == list(range(1, 800))
    assert all(r.start == r.line_no for r in lines if r.line_no % 7)


def test_empty_and_narrow_bed(spark, write):
    files = spark.createDataFrame([("e",)], "file string")
    r = qc(spark, write("e.bed", "#\n"), files)[0]
    assert (r.total_intervals, r.is_valid) == (0, True)
    assert qc(spark, write("t.bed", "chr1\t1\t2\nchr2\t-5\t 7 \n"))[0].total_bases == 13


def test_region_lists(spark, write):
    path = write("r.bed", "chr1\t10\t20\tregionA\tviewaspairs;sort BASE\t#group x; \nchr1\t5\t7\n")
    rows = src.read_bed_regions(spark, path).orderBy("line_no").collect()
    assert rows[0].commands == ["viewaspairs", "sort BASE", "group x"] and rows[0].name == "regionA"
    assert rows[1].commands == [] and rows[1].name is None
    with pytest.raises(ValueError, match="No regions"):
        src.read_bed_regions(spark, write("n.bed", "#\n"))
    with pytest.raises(Exception, match="Invalid BED entry"):
        src.read_bed_regions(spark, write("w.bed", "chr1\tx\t20\n")).collect()
    assert src.read_bed(spark, write("w2.bed", "chr1\tx\t20\nchr1\t1\t2\n")).count() == 1


GFF = "##gff-version 3\n##sequence-region chr1 1 248956422\n" + "".join(
    f"chr1\t.\tgene\t{a}\t{b}\t.\t+\t.\tID=gene{g};Name=MOCK_GENE{g}\nchr1\t.\tmRNA\t{a}\t{b}\t.\t+\t.\tID=mrna{g};Parent=gene{g}\n"
    + "".join(f"chr1\t.\texon\t{s}\t{e}\t.\t+\t.\tID=exon{s};Parent=mrna{g}\n" for s, e in exons)
    for g, a, b, exons in [
        (1, 100000, 200000, [(100000, 120000), (180000, 200000)]),
        (2, 500000, 600000, [(500000, 520000), (580000, 600000)]),
        (3, 1000000, 1100000, [(1000000, 1050000)]),
    ]
)


@pytest.mark.parametrize("name", ["MOCK_GENE1", "mock_gene1", "gene1"])
def test_gene(spark, write, name):
    features = src.read_gff3(spark, write("g.gff3", GFF))
    r = genes.find_gene(features, name).collect()[0]
    assert (r.contig, r.start, r.end) == ("chr1", 100000, 200000)
    exons = genes.gene_exons(features, name).collect()
    assert sorted((e.start, e.end) for e in exons) == [(100000, 120000), (180000, 200000)]
    assert target_regions(spark, gene=name, features=features, one_based=True).collect()[0].start == 99999


def test_gene_choice(spark, write):
    text = (
        "c\t.\tgene\tx\t9\t.\t+\t.\tID=a;Name=G\nc\t.\tGENE\t5\t9\t.\t+\t.\tid=b;name=z;NAME=g\n"
        "c\t.\tgene\t6\t9\t.\t+\t.\tID=G\nc\t.\tgene\t1\t2\n"
    )
    features = src.read_gff3(spark, write("g.gff", text))
    r = genes.find_gene(features, "G").collect()[0]
    assert (r.start, r.gene_id) == (5, "b")
    assert genes.find_gene(features, "none").count() == 0
    with pytest.raises(ValueError, match="not found"):
        target_regions(spark, gene="none", features=features)


VCF = """##fileformat=VCFv4.3
##contig=<ID=ctg:V,length=90210>
##FORMAT=<ID=GT,Number=1,Type=String,Description="call">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tleaf
ctg:V\t120\t.\tA\tG\t11\tPASS\t.\tGT\t0/1
ctg:V\t240\t.\tT\tC\t17\tPASS\t.\tGT\t1/1
ctg:V\t300\t.\tG\tC\t23\tPASS\t.\tGT\t0/1
ctg:V\t410\t.\tGTT\tG\t9\tPASS\t.\tGT\t0/1
ctg:V\t555\t.\tA\tAC\t14\tPASS\t.\tGT\t1/1
"""


def test_tiny_vcf(spark, write):
    path = write("t.vcf", VCF)
    variants = read_vcf(spark, path)
    r = vr.variant_stats(variants).collect()[0]
    assert (r.total_records, r.snps, r.indels, r.mnps, r.others, r.ts, r.tv, r.singletons) == (5, 3, 2, 0, 0, 2, 1, 3)
    assert r.ts_tv_ratio == 2.0
    header = vcf_header_lines(spark, path)
    assert [(x.name, x.length) for x in vcf_references(header).collect()] == [("ctg:V", 90210)]
    assert [x.name for x in vcf_samples(header).collect()] == ["leaf"]
    assert vr.region_filter(variants, "ctg:V:200-300").count() == 2
    # the deletion from 410 reaches 412
    assert vr.region_filter(variants, "ctg:V:412,ctgW").count() == 1
    assert vr.region_filter(variants, "ctg:V:413-").count() == 1
    assert vr.region_filter(variants, "ctg:V", contigs=["ctg:V"]).count() == 5
    table = spark.createDataFrame([("ctg:V", 411, 413), ("ctg:V", 119, 120), ("ctg:V", 100, 121), ("ctg:V", 7, 7)], "contig string, start int, end int")
    assert sorted(x.pos for x in vr.region_filter(variants, table).collect()) == [120, 410]
    report = variant_report(variants, include_indels=False).collect()[0]
    assert report.indels is None and report.snps["count"] == 3
    off = vr.variant_stats(variants, include_snps=False, include_indels=False).collect()[0]
    assert (off.snps, off.ts_tv_ratio, off.indels, off.total_records) == (None, None, None, 5)
    for bad in ("", "ctgV:x-2"):
        with pytest.raises(ValueError):
            vr.region_filter(variants, bad)


def test_sites_without_genotypes(spark, write):
    text = "c\t1\t.\tA\tC,T,<DEL>\t.\t.\tDP=3;DB\nc\t2\t.\tAC\tGT\tx\t.\t.\nc\t3\t.\tA\t.\t1\t.\t.\n"
    variants = read_vcf(spark, write("s.vcf", text))
    r = vr.variant_stats(variants).collect()[0]
    assert (r.snps, r.mnps, r.others, r.ts, r.tv, r.singletons) == (1, 1, 1, 0, 2, None)
    assert r.ts_tv_ratio == 0.0
    info = variants.orderBy("pos").collect()[0].info
    assert info == {"DP": "3", "DB": None}


def test_sample_filter(spark):
    rows = [("f", "c", 1, "A", ["C", "G"], ["GT"], ["0/1", "2/2", "./."]), ("f", "c", 2, "A", ["C"], ["GT"], ["1/1", "0/0", "0/0"])]
    df = spark.createDataFrame(rows, "file string, chrom string, pos bigint, ref string, alts array<string>, format array<string>, samples array<string>")
    names = F.array(*[F.lit(x) for x in ("a", "b", "c")])
    got = vr.sample_filter(df, "b,c", names).collect()
    assert [(r.pos, r.alts, r.alt_counts, r.samples) for r in got] == [(1, ["G"], [2], ["2/2", "./."])]
    with pytest.raises(ValueError):
        vr.sample_filter(df, "", names)


@pytest.mark.parametrize(
    "ref, alt, kind, change",
    [("A", "G", "snp", "ts"), ("a", "c", "snp", "tv"), ("A", "*", "other", None), ("AT", "A", "indel", None), ("AC", "GT", "mnp", None), ("A", "<INS>", "other", None), ("A", ".", "ref", None)],
)
def test_classes(spark, ref, alt, kind, change):
    r = spark.range(1).select(vf.variant_class(F.lit(ref), F.lit(alt)), vf.titv_class(F.lit(ref), F.lit(alt))).collect()[0]
    assert tuple(r) == (kind, change)


@pytest.mark.parametrize("text", ["chr1", "chr1:5", "chr1:a-5", "chr1:5-", ""])
def test_wrong_locations(spark, text):
    with pytest.raises(Exception, match="location"):
        spark.range(1).select(rg.parse_location(F.lit(text)).alias("r")).select("r.*").collect()


def test_region_shapes(spark):
    one = spark.range(1)

    def get(*c):
        return tuple(one.select(*c).collect()[0])

    assert get(*rg.expand_region(F.lit(100), F.lit(120), 100)) == (60, 160)
    assert get(*rg.expand_region(F.lit(1), F.lit(2), 4)) == (0, 4)
    assert get(*rg.expand_region(F.lit(1), F.lit(20), 0)) == (1, 20)
    place = (F.lit("c-1"), F.lit(5), F.lit(9))
    assert get(rg.snapshot_name(F.lit(None).cast("string"), *place)) == ("c_1_5_9.png",)
    assert get(rg.snapshot_name(F.lit("a.SVG"), *place)) == ("a.png",)
    assert get(rg.snapshot_name(F.lit("a.svg"), *place, extension="svg")) == ("a.svg",)
    assert get(tx.has_control_chars(F.lit("a\nb")), tx.has_control_chars(F.lit("a\x85b")), tx.has_control_chars(F.lit("é b"))) == (True, True, False)
    assert [get(rg.quantize_label(F.lit(d), "0:1:10:30:100:"))[0] for d in (0, 1, 29, 100)] == ["0:1", "1:10", "10:30", "100:inf"]
    assert get(rg.quantize_label(F.lit(5), "0:1:4"))[0] is None
    for bad in ("a:b", "3:1", "1::2"):
        with pytest.raises(ValueError):
            rg.parse_bins(bad)


def test_text_fields(spark):
    one = spark.range(1)
    numbers = [one.select(tx.safe_int(F.lit(x)), tx.safe_float(F.lit(x))).collect()[0] for x in ("3.0", " 7 ", "x", "1d", "+5", "1e3")]
    assert [r[0] for r in numbers] == [None, 7, None, None, 5, None]
    assert [r[1] for r in numbers] == [3.0, 7.0, None, None, 5.0, 1000.0]
    attrs = one.select(tx.gff_attrs(F.lit("ID=a;Note=x=y;flag;id=b"))).collect()[0][0]
    assert attrs == {"id": "b", "note": "x=y"}
    angle = one.select(tx.angle_map(F.lit('<ID=DP, Description="Depth, all",Source="a=b",Flag>'))).collect()[0][0]
    assert angle == {"ID": "DP", "Description": "Depth, all", "Source": "a=b", "Flag": ""}
    tags = one.select(tx.tag_map(F.array(*[F.lit(x) for x in ("CL:a:b", "none", "ID:1", "ID:2")]))).collect()[0][0]
    assert tags == {"CL": "a:b", "ID": "2"}


def test_features_at_any_depth(spark):
    """Several parents, a shared feature, a gene below another's part; cycles and too deep nests are errors."""
    rows = [
        ("gene", "G1", ""), ("gene", "G2", ""), ("mRNA", "T1", "g1"), ("mRNA", "T2", "G1, G2"), ("part", "P1", "T1,T2"),
        ("exon", "E1", "P1"), ("exon", "", "T2,P1"), ("exon", "E3", "other"), ("exon", "E4", "E1"), ("note", None, None),
    ]

    def features(rows):
        data = [("f", i, "c", kind, i * 10, i * 10 + 5, {k: v for k, v in (("id", name), ("parent", parent)) if v is not None}) for i, (kind, name, parent) in enumerate(rows)]
        return spark.createDataFrame(data, "file string, line_no bigint, seqid string, type string, start bigint, end bigint, attrs map<string,string>")

    names = spark.createDataFrame([("G1",), ("g2",), ("none",)], "gene string")
    got = {(r.gene, r.line_no): r.depth for r in genes.gene_descendants(features(rows), names).collect()}
    assert got == {
        ("G1", 2): 1, ("G1", 3): 1, ("G1", 4): 2, ("G1", 5): 3, ("G1", 6): 2, ("G1", 8): 4,
        ("g2", 3): 1, ("g2", 4): 2, ("g2", 5): 3, ("g2", 6): 2, ("g2", 8): 4,
    }
    exons = genes.gene_descendants(features(rows), "G2", types=("EXON",)).collect()
    assert {r.line_no for r in exons} == {5, 6, 8}
    assert genes.gene_descendants(features(rows), "none").isEmpty()
    with pytest.raises(ValueError, match="own ancestors"):
        genes.gene_descendants(features([*rows, ("part", "T1", "E4")]), "G1", max_depth=8)
    with pytest.raises(ValueError, match="deep"):
        genes.gene_descendants(features(rows), "G1", max_depth=3)


def test_equal_depth_rows_of_several_files_count_once(spark, tmp_path):
    """Two lines give the same region and depth from 327,600 lines apart on, and then mostly come from different files."""
    from workload.files import region_depth_ingest

    rows = [(1 + 327_600 * i, f"n{i}", 7) for i in range(4)] + [(2, "other", 9)]
    parts = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_size int").repartition(5, "p_name")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    got = sorted((r.line_no, r.region_name) for r in region_depth_ingest(spark, str(tmp_path)).collect())
    assert got == [(1, "n3"), (2, "other"), *((1 + 327_600 * i, "n3") for i in (1, 2, 3))]


ODD_CONTIGS = [
    "<ID=c1,length=5>", "<ID=,length=5>", "<ID=a,ID=>", "<ID=,ID=b>", '<ID="c,d",length=1>', '<ID="">', "<ID>", "<length=3>", "< ID=c2 >",
    "<ID =c3>", "ID=c4", "<IDX=c5>", '<note="ID=c6">', '<note="x,ID=c7",ID=c8>', "<>", "<ID=c9=2>", "<id=c10>",
]


def test_sizes_of_a_header_are_those_of_its_catalog(spark):
    rows = [("f", i, f"##{'contig' if i % 2 else 'CONTIG'}={v}") for i, v in enumerate(ODD_CONTIGS, 1)]
    rows += [("f", 99, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts9\ts1"), ("bare", 1, "##fileformat=VCFv4.3")]
    lines = spark.createDataFrame(rows, "file string, line_no bigint, value string")
    whole = {r.file: (len(r.references), len(r.samples), r.samples[0].name if r.samples else None) for r in hd.vcf_header_catalog(lines).collect()}
    sizes = hd.vcf_header_sizes(lines)
    assert {r.file: (r.references, r.samples, r.first_sample) for r in sizes.collect()} == whole
    assert whole["f"][0] > 5 and whole["f"][1:] == (2, "s9") and whole["bare"] == (0, 0, None)
    named = spark.createDataFrame([(v,) for v in ODD_CONTIGS], "v string")
    got = named.select(tx.has_angle_value(F.col("v"), "ID"), F.coalesce(tx.angle_map(F.col("v"))["ID"] != "", F.lit(False))).collect()
    assert [a for a, _ in got] == [b for _, b in got]


def test_short_look_at_contigs_is_that_of_the_map(spark):
    odd = [
        "<ID=a>", "<ID=a,length=5>", "<ID=a, ID=>", "<ID=a,\tID=b>", "<ID=a,ID >", "<ID=a,ID>", "<ID=a,IDX=1>", "<ID=a,x=ID=>", "<ID= >", "<ID=>>", "<ID=>",
        "<ID=\t>", "<ID=a>b,x=1>", "<ID=\u0085x>", "<ID=a\u0085x>", "<ID=a\u2028>", "<ID=a>\r", "<ID=a\r>", "<ID=,>", "<ID=,ID=a>", "<ID=a,>", "<ID=a,,ID=>", "<ID=a",
        '<ID=a,note="ID=">', '<ID=a,note="x,ID=,">', '<ID=">', '<ID=a,ID="">', "<ID==>", "<ID=é,x>", "<id=a>", "<ID=a,id=>",
    ]
    named = spark.createDataFrame([(v,) for v in odd], "v string")
    got = named.select("v", tx.has_angle_value(F.col("v"), "ID").alias("short"), F.coalesce(tx.angle_map(F.col("v"))["ID"] != "", F.lit(False)).alias("whole"))
    assert [tuple(r) for r in got.where("short <> whole").collect()] == [] and got.where("short").count() > 10


def test_only_sample_names_are_sorted_for_sizes(spark, capsys):
    """The first name is the least of structs, for which Spark sorts the rows it adds up: no row of a contig is among them."""
    lines = spark.createDataFrame([("f", 1, "##contig=<ID=c1>")], "file string, line_no bigint, value string")
    hd.vcf_header_sizes(lines).explain()
    plan = capsys.readouterr().out
    contigs = plan[: plan.index("CONTIG")]
    assert contigs.rindex("HashAggregate(") > contigs.rindex("SortAggregate(")


def test_a_long_header_is_counted_without_one_row_of_it(spark, capsys):
    from workload.edges import vcf_header_long

    vcf_header_long(spark, "/root/testdata/sf0.001").explain()
    assert "collect_list" not in capsys.readouterr().out
