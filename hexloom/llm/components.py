"""Connected components of an edge table by alternating stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.common import discard
from hexloom.llm.skew import join_groups
from hexloom.session import settle


def _star(links: DataFrame, keep: str) -> DataFrame:
    """Every node tells the neighbours chosen by ``keep`` about the smallest node it knows."""
    least = settle(
        links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.expr("count(1) AS degree")), "least"
    )
    told = join_groups(links, least, ["u"], "degree")
    out = told.filter(keep).selectExpr("v AS a", "m AS b")
    star = settle(out.unionByName(least.selectExpr("u AS a", "m AS b")).filter("a != b").distinct(), "star")
    discard(least)
    return star


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Large and small stars alternate until nothing changes; the number of rounds grows with the
    logarithm of the longest chain. Each round is written to the shared folder. Nodes with very many
    neighbours only meet others as one row, see ``join_groups``.
    """
    edges = settle(edges.selectExpr(f"{a} AS a", f"{b} AS b").filter("a != b").distinct(), "edges")
    before = None
    while True:
        large = _star(edges.selectExpr("inline(array(struct(a AS u, b AS v), struct(b AS u, a AS v)))"), "v > u")
        last, edges = edges, _star(large.selectExpr("greatest(a, b) AS u", "least(a, b) AS v"), "true")
        for finished in (last, large):
            discard(finished)
        state = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(a, b) as decimal(20, 0)))")).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return settle(edges.selectExpr("a AS node", "b AS component").unionByName(roots), "components")
