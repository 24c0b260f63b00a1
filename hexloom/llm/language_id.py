"""Language of a text: nearest of several centroids per language, by cosine of TF-IDF n-grams.

Document frequencies come from all learning documents; the centroids from a sample of at most
``SAMPLE`` of them in expectation, drawn evenly over the languages by a hash of the id. Spherical
k-means splits each language into ``CENTROIDS`` clusters. A text is rejected when its cosine to the
best centroid is under ``MARGIN`` of the ``QUANTILE`` of those that all learning texts of that language
and of like length (by powers of two) have to theirs. A length that has fewer than ``LEAST`` of them takes
the floor of the nearest shorter one that has, else that of the nearest longer one, less by the root of
the ratio; a language without any takes it from all lengths together.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0 and rejected; so
is every text when there is nothing to learn from. Of equal cosines the first language by name wins.
Learning rows need a language and a letter. Very long texts are counted in pieces. Other columns of
the input take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import remainder, small_batches, whole_text
from hexloom.llm.ngrams import MEASURED, blocks, dense, frequencies, inverse_frequency, letters_table, measure, weighted
from hexloom.session import settle

DIMS, ORDERS = 4096, (2, 3)
SAMPLE = 4000
CENTROIDS = 4
QUANTILE, MARGIN, LEAST = 0.01, 0.8, 20
#: Powers of two told apart in the length of a text.
LENGTHS = 16
UNKNOWN = "und"


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    languages: list[str]  # of each row, in order
    floors: np.ndarray  # of each row and power of two in the length: the least cosine that isn't rejected


def _clusters(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced members."""
    k = min(k, len(vectors))
    centroids = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(8):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(k)])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on rows of (doc_id, text, lang); None if there are none to learn from."""
    usable = docs.filter("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = sample / len(sizes)
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, share / n))])
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(rates, F.col("lang")) * (1 << 20)
    tagged = usable.select("text", F.when(chosen, F.col("lang")).alias("tag"))
    measured = settle(tagged.mapInArrow(measure(letters_table(), ORDERS, DIMS), MEASURED), "language")
    idf = inverse_frequency(*frequencies(measured, DIMS))
    centroids, languages = [], []
    for lang in sorted(sizes):
        block = dense(measured.filter(F.col("tag") == lang).orderBy(F.xxhash64("dims", "values")), DIMS)
        if not len(block):
            continue
        vectors = weighted(block, idf)
        own = _clusters(vectors, CENTROIDS)
        centroids.append(own)
        languages += [lang] * len(own)
    if not centroids:
        return None
    model = Model(idf, np.concatenate(centroids), languages, np.full((len(languages), LENGTHS), -1.0))
    model.floors = _floors(identify(usable, model), languages)
    return model


def _floors(found: DataFrame, languages: list[str]) -> np.ndarray:
    """Floors from the cosines of all learning rows to the centroids of their own language."""
    size = F.least(F.floor(F.log2(F.length("text"))), F.lit(LENGTHS - 1)).cast("int")
    right = found.filter("language.lang_pred = lang").select("lang", size.alias("size"), "language.score")
    low = right.groupBy("lang", "size").agg(F.count("score").alias("n"), F.expr(f"percentile_approx(score, {QUANTILE}, 10000)").alias("low"))
    out = {lang: np.zeros(LENGTHS) for lang in languages}
    rows: dict[str, list] = {}
    for r in low.orderBy("lang", "size").collect():
        rows.setdefault(r["lang"], []).append(r)
    for lang, own in rows.items():
        known = {r["size"]: r["low"] for r in own if r["n"] >= LEAST}
        if not known:
            known = {own[0]["size"]: min(r["low"] for r in own)}
        for k in range(LENGTHS):
            below = [c for c in known if c <= k]
            out[lang][k] = MARGIN * (known[max(below)] if below else known[min(known)] * 2 ** ((k - min(known)) / 2))
    return np.stack([out[lang] for lang in languages])


def _predict(model: Model | None, texts: list[str | None], lettered: list[bool]) -> tuple[list, list, list]:
    if model is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    table, names, scores, rejected = letters_table(), [], [], []
    for block in blocks(texts, table, ORDERS, DIMS):
        near = weighted(block, model.idf) @ model.centroids.T
        best = near.argmax(axis=1)
        score = near[np.arange(len(best)), best]
        names += [model.languages[b] for b in best]
        scores += np.clip(score, 0, 1).astype(float).tolist()
        sizes = [min(max(len(t or ""), 1).bit_length(), LENGTHS) - 1 for t in texts[len(rejected) : len(rejected) + len(best)]]
        rejected += (score < model.floors[best, sizes]).tolist()
    return (
        [n if ok else UNKNOWN for n, ok in zip(names, lettered, strict=True)],
        [s if ok else 0.0 for s, ok in zip(scores, lettered, strict=True)],
        [r if ok else True for r, ok in zip(rejected, lettered, strict=True)],
    )


def identify(docs: DataFrame, model: Model | None, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct (lang_pred, score, rejected); rows stay where they are."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts, lettered):
        import pandas as pd

        names, scores, rejected = _predict(shared.value, texts.tolist(), lettered.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores, "rejected": rejected})

    return docs.withColumn(into, predict(whole_text(text), whole_text(text).rlike("\\p{L}")))


def split(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from."""
    return docs.filter(remainder("doc_id", 3) != 1)


def languages(docs: DataFrame) -> DataFrame:
    """Learn and predict: doc_id, held_out, lang_pred, score, rejected."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    model = learn(split(docs))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "language.*")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that belong to no learnt language."""
    small_batches(docs.sparkSession)
    model = learn(split(docs.select("doc_id", "text", "lang")))
    return identify(docs, model, into="__language").filter("NOT __language.rejected").drop("__language")
