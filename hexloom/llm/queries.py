"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.llm import ann, clustering, hard_negatives, language_id, packing, passages, quality, quality_rules, secrets, suffix_tree_lm, trie_bpe
from hexloom.llm.common import table
from hexloom.llm.exact_dedup import exact_groups
from hexloom.llm.near_dedup import near_components


VOCABULARY = "byte_bpe_50k.json"


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"), depth=None)


def op3_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op9_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "{id} % 20 = 0")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS label")
    return quality.qualities(table(spark, sf_dir, "documents"), labels)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.mine(vectors, "{id} % 100 = 0")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS label")
    return quality_rules.judge(table(spark, sf_dir, "documents"), labels)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_tree_lm": op2_suffix_tree_lm,
    "op3_trie_bpe": op3_trie_bpe,
    "op4_packing": op4_packing,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_ann_forest": op9_ann_forest,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_clustering": op12_clustering,
    "op13_quality_rules": op13_quality_rules,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _clustering_sql(rounds: int = 10) -> str:
    """The rounds written out, one row per vector and dimension."""
    floor = "(sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*)"
    parts = [
        """kept AS MATERIALIZED (
          SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "x AS MATERIALIZED (SELECT rn, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept)",
        """first AS (SELECT rn, row_number() OVER (ORDER BY h, v) - 1 AS c
          FROM (SELECT rn, v, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept) ORDER BY h, v LIMIT 8)""",
        "c0 AS MATERIALIZED (SELECT c, d, x AS m FROM first JOIN x USING (rn))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
          SELECT rn, c, dist FROM (SELECT rn, c, sum((x.x - m) * (x.x - m)) AS dist FROM x JOIN c{i} USING (d) GROUP BY rn, c)
          QUALIFY row_number() OVER (PARTITION BY rn ORDER BY dist, c) = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
          SELECT o.c, o.d, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (
            SELECT c, d, {floor} AS m FROM a{i} JOIN x USING (rn) GROUP BY c, d) n ON o.c = n.c AND o.d = n.d)""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
          CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
          h AS centroid_sha256
        FROM a{rounds} JOIN kept USING (rn)
        JOIN (SELECT c, sha256(string_agg(CAST(CAST(m AS BIGINT) AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c) USING (c)"""


ORACLE = {
    "op6_exact_dedup": f"""
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM (SELECT doc_id, text_sha256, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size
              FROM (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
              WINDOW g AS (PARTITION BY text_sha256))""",
    "op11_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
            CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id AND len(a.v) = len(b.v)),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
          CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
          vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10""",
    "op12_clustering": _clustering_sql(),
}
