"""Plans and steps whose cost must not grow faster than the tables."""

import pytest
from geo import SQUARE, polygons, shift

from hexloom.operators import cells as C
from hexloom.operators import outlines as R
from hexloom.operators import polygons as P
from hexloom.session import settle
from hexloom.workload import queries as Q


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_that_meet_are_never_broadcast(spark):
    """Estimates from before the explode made one side look small, and the driver had to hold it."""
    shapes = settle(polygons(spark, a=SQUARE, b=shift(SQUARE, 1, 0.5)).selectExpr("id", "'g' AS grp", "rings"))
    check = R.coverage_check(P.edges(shapes, "id", keep=("grp",)), "grp", 500.0)
    assert "Broadcast" not in _plan(check)
    assert check.collect() == [("g", 0, 2, 0)]


@pytest.mark.parametrize("limit, join", [(10_000, "BroadcastHashJoin [bx"), (0, "SortMergeJoin [bx")])
def test_touch_broadcasts_only_counted_cells(spark, monkeypatch, limit, join):
    """The polygons are never the broadcast side, whatever their file's size says."""
    monkeypatch.setattr(C, "BROADCAST_CELLS", limit)
    shapes = polygons(spark, **{f"s{i}": shift([[(0, 0), (40, 0), (40, 30)]], 25 * i, 3 * i) for i in range(12)})
    cover = C.hex_cover(P.edges(shapes, "id"), "id", 12, "touch")
    plan = _plan(cover)
    assert join in plan and "BuildLeft" not in plan
    pairs = {tuple(r) for r in cover.collect()}
    center = {tuple(r) for r in C.hex_cover(P.edges(shapes, "id"), "id", 12, "center").collect()}
    assert center < pairs and len({k for k, _ in pairs}) == 12


def test_shells_are_counted_once_a_text(spark, monkeypatch):
    """Beside the explode, the whole text was carried to and split for each of its rings."""
    text = "MULTIPOLYGON (((380000 5810000, 380004 5810000, 380000 5810002, 380000 5810000)), ((380010 5810000, 380012 5810000, 380010 5810002, 380010 5810000)))"
    monkeypatch.setattr(Q.R, "dissolve", lambda *a: None)
    monkeypatch.setattr(Q, "_plot_edges", lambda *a: None)
    stored = settle(spark.range(1).selectExpr("1 AS group_id", "2L AS rings", f"'{text}' AS geometry"))
    monkeypatch.setattr(Q.R, "outline_shapes", lambda *a: stored)
    shapes = Q.outline_shapes(spark, None)
    assert [tuple(r) for r in shapes.collect()] == [(1, 2, 2, 6.0)]
    carried = [line for line in _plan(shapes).split("\n") if "Generate explode" in line]
    assert carried and not any("geometry" in line for line in carried)


def test_rules_are_summed_before_they_are_joined(spark):
    """All values of a rule came to one task to be counted there."""
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c")], "k int, s string")
    from hexloom.operators.quality import expect_all

    found = expect_all(rows, not_null=["k", "s"], unique=["k", "s"], in_set=[("s", ["a"]), ("s", ["a", "b", "c"])], min_rows=4)
    before_run = _plan(found)
    before_run = before_run[before_run.index("Join") :]
    assert {tuple(r) for r in found.collect()} == {
        ("not_null", "k", 1), ("not_null", "s", 1), ("unique", "k", 1), ("unique", "s", 0),
        ("accepted_values", "s", 2), ("accepted_values", "s", 0), ("min_rows", "*", 1),
    }
    assert before_run.count("HashAggregate") >= 4
