"""Small awkward tables: nulls, empty and long texts, repeated rows, columns with clashing names."""

import re

from strandlens.llm import bpe  # noqa: F401  (the folder is pointless without the package)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Rows with nulls in every column, repeated rows, and names that operators use themselves."""
    base = "the quick brown fox jumps over the lazy dog while it rains again"
    rows = [
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (2, base + " Now", "en", "a", 1),
        (3, None, None, None, None),
        (None, "null id here with five words", "en", "b", 2),
        (None, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "en", "b", 4),
        (6, "word " * 30_000, "en", "b", 150_000),
        (7, "é中\U0001f600 don't  'stop\u00a0it\u3000x", "en", "", 5),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    clashing = {c: docs["lang"] for c in ("size", "Taken", "key", "shard", "score", "row", "h", "label", "place", "target")}
    return docs.withColumns(clashing)


def empty(spark):
    return spark.createDataFrame([], DOCS)
