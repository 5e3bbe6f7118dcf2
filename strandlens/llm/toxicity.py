"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlens.llm.common import batches_of
from strandlens.llm.words import chained, hashed_words, slices

BUCKETS = 1 << 20
TRAIN_PER_CLASS = 10_000
TRAIN_PARTS = 1
ROWS_PER_BATCH = 2000
MAX_CLASS_WEIGHT = 5.0
EPOCHS = 3
GRAMS = ((0,), (0, 1), (0, 2))
"""Words, pairs of neighbours, and pairs with one word between."""


@dataclass(frozen=True)
class Ftrl:
    """Rate and penalties of the per-coordinate update."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0


@dataclass(frozen=True)
class Model:
    """Sparse weights: at most ``BUCKETS`` entries of 8 bytes, which bounds their broadcast."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.places] = self.weights
        return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every n-gram and skip-gram, repeats included."""
    words = hashed_words(texts, "punctuation")
    owner = words.texts
    owners, places = [], []
    for steps in GRAMS:
        grams = chained(words.hashes, steps)
        inside = owner[: len(grams)] == owner[len(owner) - len(grams) :]
        owners.append(owner[: len(grams)][inside])
        places.append((grams[inside] & np.uint64(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(places)


def train(rows: list[np.ndarray], labels: np.ndarray, rate: Ftrl, epochs: int, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias after some passes over rows of distinct buckets, in seeded order.

    If toxic rows are fewer, their gradients count that many times more, up to a bound.
    """
    toxic = labels.sum()
    heavier = float(np.clip((len(labels) - toxic) / max(toxic, 1), 1, MAX_CLASS_WEIGHT))
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * rate.l1) / ((rate.beta + np.sqrt(n[at])) / rate.alpha + rate.l2)
        return np.where(np.abs(zs) <= rate.l1, 0.0, w)

    order = np.random.default_rng(seed)
    bias = np.array([BUCKETS])
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = np.append(rows[i], bias)
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            gradient *= heavier if labels[i] else 1.0
            before = n[at]
            after = before + gradient * gradient
            z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / rate.alpha * w
            n[at] = after
    w = weights(slice(None))
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: a fifth, by the checksum of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rate: Ftrl | None = None,
    per_class: int = TRAIN_PER_CLASS,
    parts: int = TRAIN_PARTS,
    epochs: int = EPOCHS,
) -> Model:
    """Fits on at most ``per_class`` labelled documents of each class, the first by a hash of the id.

    Held out documents are not among them. That bound is the only one: a part (all of the sample by default) is
    learnt in one task, and the weights of the parts, if there are more, are averaged. Labels that are null are ignored; of an id labelled twice the
    higher label counts; a null id is held out. Without labels the model scores everything alike.
    """
    rate = rate or Ftrl()
    named = labels.select(F.col(doc_id).alias("of_id"), F.col(label).cast("int").alias("label"))
    known = (
        named.where(F.col("label").isNotNull() & ~held_out(F.col("of_id")))
        .groupBy("of_id")
        .agg((F.max("label") > 0).cast("int").alias("label"))
    )
    by_hash = F.xxhash64(F.lit(7), "of_id"), F.col("of_id")
    sample = (known.where(F.col("label") == k).orderBy(*by_hash).limit(per_class) for k in (0, 1))
    sample = reduce(DataFrame.union, sample)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("of_id")
    )

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owner, place = features(part.column("text"))
                key = np.unique(owner.astype(np.int64) * BUCKETS + place)
                cuts = np.searchsorted(key, np.arange(part.num_rows + 1, dtype=np.int64) * BUCKETS)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((key % BUCKETS).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("part"), part.column("label"), part.column("doc_id"), lists], ["part", "label", "doc_id", "places"]
                )

    def to_weights(group: pa.Table) -> pa.Table:
        # views of the sample's buckets, chunk by chunk, in the order of ids
        rows: list[np.ndarray] = []
        for chunk in group.column("places").chunks:
            flat, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
            rows += [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
        order = pc.sort_indices(group.select(["doc_id", "label"]), [("doc_id", "ascending"), ("label", "ascending")]).to_pylist()
        labels_of = group.column("label").to_numpy().astype(float)[order]
        weights, bias = train([rows[i] for i in order], labels_of, rate, epochs)
        at = np.flatnonzero(weights)
        places, values = np.append(at, BUCKETS).astype(np.int32), np.append(weights[at], bias)
        return pa.table([pa.array(places), pa.array(values)], names=["place", "weight"])

    kind = docs.schema[doc_id].dataType.simpleString()
    weights_of = (
        chosen.select("text", "label", "doc_id", F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(parts)).cast("int").alias("part"))
        .mapInArrow(to_features, f"part int, label int, doc_id {kind}, places array<int>")
        .groupBy("part")
        .applyInArrow(to_weights, "place int, weight double")
        .groupBy("place")
        .agg((F.sum("weight") / parts).alias("weight"))
        .orderBy("place")
    )
    with batches_of(docs.sparkSession, ROWS_PER_BATCH):
        fitted = weights_of.toPandas()
    bias = float(fitted.loc[fitted["place"] == BUCKETS, "weight"].sum()) if len(fitted) else 0.0
    fitted = fitted[fitted["place"] < BUCKETS]
    return Model(fitted["place"].to_numpy(np.int32), fitted["weight"].to_numpy(np.float32), bias)


def score_texts(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of each text: bias and the weights of its distinct buckets."""
    owner, place = features(texts)
    heavy = weights[place] != 0
    key = np.unique(owner[heavy].astype(np.int64) * BUCKETS + place[heavy])
    sums = np.bincount(key // BUCKETS, weights[key % BUCKETS], len(texts)) if len(key) else np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(sums + bias, -35, 35)))


def score_toxicity(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep_row: bool = False
) -> DataFrame:
    """Scores every whole text: ``doc_id``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    With ``keep_row`` also the struct ``row`` of the input. Nothing but the text enters a score. Null
    and empty texts get the score of the bias alone; repeated rows get equal scores; an empty table
    gives no rows; other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # the text goes to Python once, by itself or in its row
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.struct("*").alias("row") if keep_row else F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value.dense(), shared.value.bias
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), [text]) if keep_row else batch.column("text")
            parts = slices(pa.RecordBatch.from_arrays([texts], ["text"]))
            scores = [score_texts(part.column("text"), weights, bias) for part in parts]
            score = np.concatenate(scores) if scores else np.zeros(0)
            names = [f for f in batch.schema.names if f != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f) for f in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                [*names, "score", "predicted"],
            )

    return chosen.mapInArrow(run, chosen.drop("text").schema.add("score", "double").add("predicted", "integer"))
