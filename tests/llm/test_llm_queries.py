"""Registered queries against SQL, and the pipeline against its parts."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from strandlens.llm.queries import ORACLE, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_is_its_sql(spark, name):
    assert not compare(QUERIES[name](spark, SF), duck(SF), ORACLE[name])


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs
    seen = {"start": docs.count()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        out.write.parquet(str(tmp_path / name))
        before, rows = rows, spark.read.parquet(str(tmp_path / name))
        seen[name] = rows.count()
        if name != "byte_bpe":
            assert rows.columns == columns and dict(rows.dtypes) == dict(docs.dtypes)
        if name == "toxicity":
            assert rows.exceptAll(before).isEmpty() and 0 < seen[name] <= seen["start"]
        if name == "ngram_jaccard_join":
            assert rows.exceptAll(before).isEmpty() and 0 < seen[name] < seen["toxicity"]
            assert corpus_pipeline.drop_near_copies(spark, rows, SF).count() == seen[name]
        if name == "secret_scan":
            assert seen[name] == seen["ngram_jaccard_join"]
            assert rows.where("text NOT LIKE '%<secret>%'").select("doc_id", "text").exceptAll(before.select("doc_id", "text")).isEmpty()
        if name == "source_mixing":
            assert rows.distinct().exceptAll(before).isEmpty()
        if name == "byte_bpe":
            assert seen[name] == before.count()
    assert {r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == {r.ids_sha256 for r in rows.collect()}
