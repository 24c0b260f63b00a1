"""Exact duplicates by two passes over a Bloom filter.

Pass one fills a filter with the hashes that may occur more than once. Pass two probes it: a row
without a hit is unique and passes straight through; only the others are shuffled, as (digest, id).

Defined cases: a null text equals the empty one; repeated ids count as rows of their own, and all
rows of a group that carry the largest id are kept; a group of null ids has a null ``keep_id`` and is
kept; an empty table gives an empty result; other columns of the input take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.llm import bloom
from hexloom.llm.common import lower_az, whole_text
from hexloom.llm.skew import join_groups
from hexloom.session import settle


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """(doc_id, text_sha256, maybe): the digest of each normalised text, and whether it may repeat."""
    plain = docs.select(F.col(id).alias("doc_id"), lower_az(whole_text(text)).alias("_text"))
    hashed = plain.select(F.xxhash64("_text").alias("_hash"))
    repeats, segments = bloom.build(hashed, "_hash", docs.count(), twice=True, max_bits=max_bits)
    slim = plain.select("doc_id", F.sha2("_text", 256).alias("text_sha256"), F.xxhash64("_text").alias("_hash"))
    return bloom.possibly(slim, "_hash", settle(repeats, "filter"), segments, "maybe").drop("_hash")


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = settle(digests(docs, id, text, max_bits), "digests")
    suspects = rows.filter("maybe").drop("maybe")
    groups = settle(
        suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.expr("count(1) AS group_size")), "groups"
    )
    several = join_groups(suspects, groups, ["text_sha256"], "group_size")
    single = rows.filter("NOT maybe").selectExpr("doc_id", "text_sha256", "doc_id AS keep_id", "1L AS group_size")
    return single.unionByName(several).select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id AS kept"), "text_sha256"
    )


def drop_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` doesn't keep; unaffected rows aren't shuffled."""
    dropped = exact_groups(docs, id, text).filter("NOT kept").select(F.col("doc_id").alias("__dropped"), F.col("text_sha256").alias("__of"))
    # An id may stand on several texts, of which only some repeat.
    return without_ids(docs, settle(dropped.distinct(), "dropped"), "__dropped", id, F.sha2(lower_az(whole_text(text)), 256))


def without_ids(docs: DataFrame, dropped: DataFrame, column: str, id: str = "doc_id", digest: Column | None = None) -> DataFrame:
    """``docs`` without the ids in ``dropped`` (settled, non-null): a filter passes all others straight on.

    With a digest, only rows go whose digest stands beside their id as ``__of``.
    """
    ids, segments = bloom.build(dropped, column, dropped.count())
    flagged = bloom.possibly(docs, id, settle(ids, "filter"), segments, "__maybe")
    passed = flagged.filter("NOT __maybe").drop("__maybe")
    doubtful = flagged.filter("__maybe").drop("__maybe")
    if digest is None:
        return passed.unionByName(doubtful.join(dropped, doubtful[id] == dropped[column], "left_anti"))
    doubtful = doubtful.withColumn("__digest", digest)
    return passed.unionByName(doubtful.join(dropped, (doubtful[id] == dropped[column]) & (F.col("__digest") == F.col("__of")), "left_anti").drop("__digest"))
