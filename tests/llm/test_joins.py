"""Joins of rows to groups, with large groups and without, and components that grow by links."""

from hexloom.llm import near_dedup
from hexloom.llm.components import components
from hexloom.llm.skew import join_groups


def _joined(spark, sizes):
    rows = spark.createDataFrame([(k, i) for k, n in enumerate(sizes) for i in range(n)], "k long, i long")
    groups = spark.createDataFrame([(k, n) for k, n in enumerate(sizes) if k], "k long, n long")
    return join_groups(rows, groups, ["k"], "n")


def test_without_large_groups_it_is_one_join(spark):
    got = _joined(spark, [3, 4, 5])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "LeftAnti" not in plan
    assert sorted(map(tuple, got.collect())) == [(k, i, n) for k, n in ((1, 4), (2, 5)) for i in range(n)]


def test_large_groups_are_broadcast(spark):
    got = _joined(spark, [3, 2500, 5])
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(k, i, n) for k, n in ((1, 2500), (2, 5)) for i in range(n)]


def test_components_of_no_groups(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_grow_by_links(spark):
    edges = lambda *pairs: spark.createDataFrame(pairs or [], "a long, b long")
    found = components(edges((5, 4), (4, 3), (9, 8)), "a", "b")
    assert near_dedup._joined(found, edges()) is found
    got = near_dedup._joined(found, edges((8, 5), (20, 21)))
    assert sorted(map(tuple, got.collect())) == [(3, 3), (4, 3), (5, 3), (8, 3), (9, 3), (20, 20), (21, 20)]
