"""Quality of a text by voting of its nearest labelled neighbours in a latent space.

Document frequencies of surface n-grams come from all documents. The labelled vectors are a sample of
at most ``SAMPLE`` learning rows in expectation, drawn by a hash of the id; their TF-IDF rows give a
basis of ``LATENT`` directions (truncated singular value decomposition). Basis and labelled vectors
have a fixed size and are broadcast. Every document is projected, and its cosines to all labelled
vectors are computed exactly, block by block; the ``NEIGHBOURS`` nearest vote with their similarity.

Defined cases: a text without n-grams in common with any neighbour, an empty or a null one gets the
share of label 1 among the labelled vectors, and 0.5 where there are none. Ties among neighbours are
settled by their fixed order. Null labels and repeated labels of an id are left out or merged to the
largest. Very long texts are counted in pieces. Other columns of the input take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import remainder, small_batches, whole_text
from hexloom.llm.ngrams import MEASURED, blocks, dense, frequencies, inverse_frequency, measure, surface_table, weighted
from hexloom.session import settle

DIMS, ORDERS = 4096, (1, 3)
SAMPLE = 4000
LATENT = 64
NEIGHBOURS = 25


#: How often a text repeats its n-grams, as terms beside them: steps of the logarithm, and their weight.
REPEATS, REPEAT_WEIGHT = 12, 0.8


def features(block: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one, followed by two neighbouring steps of the mean count of an n-gram."""
    terms = weighted(block, idf)
    distinct = (block > 0).sum(axis=1)
    step = np.clip(np.log2(block.sum(axis=1) / np.maximum(distinct, 1) + 1e-9) * 1.5, 0, REPEATS - 1.001)
    low, part = step.astype(int), step - step.astype(int)
    repeats = np.zeros((len(block), REPEATS), np.float32)
    at = np.arange(len(block))
    repeats[at, low], repeats[at, low + 1] = 1 - part, part
    repeats *= (distinct > 0)[:, None] * np.float32(REPEAT_WEIGHT)
    return np.concatenate([terms, repeats], axis=1)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _basis(rows: np.ndarray, k: int) -> np.ndarray:
    """Leading right singular vectors, by a randomised range finder with four power steps."""
    found = np.random.default_rng(7).standard_normal((rows.shape[1], min(2 * k, rows.shape[1]))).astype(np.float32)
    for _ in range(4):
        found, _ = np.linalg.qr(rows.T @ (rows @ found))
    _, _, right = np.linalg.svd(rows @ found, full_matrices=False)
    return (found @ right.T)[:, :k]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on (doc_id, text) and (doc_id, label); None if no label may be learnt from."""
    usable = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1))
    rate = min(1.0, sample / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").cast("string").alias("tag"))
    # The sample has a fixed expected size, so it is broadcast and the texts stay where they are.
    tagged = docs.join(F.broadcast(chosen), "doc_id", "left").select(whole_text().alias("text"), "tag")
    measured = settle(tagged.mapInArrow(measure(surface_table(), ORDERS, DIMS), MEASURED), "quality")
    rows = measured.filter("tag IS NOT NULL").orderBy("tag", F.xxhash64("dims", "values"))
    tags = [int(r[0]) for r in rows.select("tag").collect()]
    if not tags:
        return None
    idf = inverse_frequency(*frequencies(measured, DIMS))
    block = features(dense(rows, DIMS), idf)
    basis = _basis(block, LATENT)
    return Model(idf, basis, _unit(block @ basis).astype(np.float32), np.array(tags, np.float32))


def _vote(model: Model, latent: np.ndarray) -> np.ndarray:
    near = latent @ model.vectors.T
    k = min(NEIGHBOURS, near.shape[1])
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, best, axis=1), 0)
    total = weight.sum(axis=1)
    votes = (weight * model.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
    return np.where(total > 0, votes, model.labels.mean())


def score(docs: DataFrame, model: Model | None, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; rows stay where they are."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def vote(texts):
        import pandas as pd

        model, out = shared.value, []
        if model is None:
            return pd.Series([0.5] * len(texts))
        for block in blocks(texts.tolist(), surface_table(), ORDERS, DIMS):
            out += np.clip(_vote(model, _unit(features(block, model.idf) @ model.basis)), 0, 1).astype(float).tolist()
        return pd.Series(out, dtype=float)

    return docs.withColumn(into, vote(whole_text(text)))


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn and score: doc_id, held_out, score, predicted. ``labels`` has doc_id and label."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    scored = score(docs, learn(docs, labels.select("doc_id", "label")))
    return scored.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", F.expr("cast(score >= 0.5 as int) AS predicted")
    )
