"""A corpus from raw documents: toxic ones go, near copies go, secrets are masked, sources are mixed, texts are encoded.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the
last return the columns of ``documents``. The stages share executors and Python workers, which keep much of the
memory that they once took, so every stage reads and passes on whole texts in small batches.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlens.llm import bpe, mixing, ngram_join, secrets, toxicity
from strandlens.llm.common import small_batches, table, written

SECRET_MARK = "<secret>"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of these documents."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, keep_row=True).where("predicted = 0").select("row.*")


@_in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    return ngram_join.one_of_each(docs)


@_in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text."""
    found = secrets.scan_secrets(docs, redact=SECRET_MARK, keep_row=True)
    changed = F.col("spans") != ""
    new = {"text": F.col("redacted"), "n_chars": F.when(changed, F.length("redacted").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


@_in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of each document for the words that the mix takes of it; what rounding leaves goes on within the source."""
    mixed = mixing.with_copies(mixing.mix_sources(docs, keep_row=True))
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


@_in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (little-endian 32-bit numbers), their number, and digests of ids and decoded bytes."""
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix),
    ("byte_bpe", encode),
]

# a learnt classifier, novelty by compression and seeded selection have no form in SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
