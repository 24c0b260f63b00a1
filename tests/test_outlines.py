"""Unions, coverage faults, rings and shapes of imperfect polygons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geo import A1, SQUARE, inside, polygons, shift
from hexloom.operators import outlines as R
from hexloom.operators import polygons as P

HALVES = {"low": [[(1, 0), (2, 0), (2, 0.5), (1, 0.5)]], "high": [[(1, 0.5), (2, 0.5), (2, 1), (1, 1)]]}


def slanted(rings, dx=0.0, dy=0.0, shear=0.0):
    return [[(x + shear * y + dx, y + dy) for x, y in ring] for ring in rings]


def union(spark, shapes, side=3.0):
    edges = P.edges(polygons(spark, **shapes), "id").withColumn("g", F.lit("g"))
    return edges, R.dissolve(edges, "g", side)


def facts(outline):
    length = P.outline_length(outline, "g").first()["length_m"]
    return length, P.polygon_area(P.with_origin(outline, "g"), "g").first()["area_m2"]


@pytest.mark.parametrize("dx, dy, shear", [(0, 0, 0), (380123.1, 5810456.7, -1.5)])
def test_tjunctions_and_overlaps(spark, dx, dy, shear):
    place = lambda rings: slanted(rings, dx, dy, shear)
    up = math.hypot(1, shear)
    edges, outline = union(spark, {"a": place(SQUARE)} | {k: place(v) for k, v in HALVES.items()})
    assert facts(outline) == pytest.approx((4 + 2 * up, 2.0), abs=1e-5)
    fault = R.coverage_check(edges, "g", 3.0).first()
    assert (fault["open_vertices"], fault["t_junctions"], fault["crossings"]) == (0, 1, 0)
    edges, outline = union(spark, {"a": place(SQUARE), "b": place(shift(SQUARE, 0.5, 0))})
    assert facts(outline) == pytest.approx((3 + 2 * up, 1.5), abs=1e-5)
    assert R.coverage_check(edges, "g", 3.0).first()["t_junctions"] == 4
    edges, outline = union(spark, {"a": place(SQUARE), "b": place(shift(SQUARE, 0.5, 0.25))})
    assert facts(outline)[1] == pytest.approx(1.625, abs=1e-5)
    assert R.coverage_check(edges, "g", 3.0).first()["crossings"] == 4  # Two places, on both edges.
    clean = R.coverage_check(outline, "g", 3.0).first()
    assert (clean["open_vertices"], clean["t_junctions"], clean["crossings"]) == (0, 0, 0)


def test_covered_twice_whole_and_in_holes(spark):
    """The same shape twice, one inside another, and a hole that a second shape fills in part."""
    inner = [[(1, 1), (2, 1), (2, 1.75), (1, 1.75)]]
    assert facts(union(spark, {"a": A1, "b": A1})[1]) == pytest.approx((40 + 7, 61.0))
    assert facts(union(spark, {"a": [A1[0]], "b": inner})[1]) == pytest.approx((40, 64.0))
    assert facts(union(spark, {"a": A1, "b": inner})[1])[1] == pytest.approx(61.75)


@pytest.mark.parametrize("seed", range(2))
def test_random_triangles_against_a_raster(spark, seed):
    rng = random.Random(seed)
    shapes = {f"t{i}": [[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)]] for i in range(14)}
    _, outline = union(spark, shapes, 2.0)
    step, n = 0.02, 500
    hit = sum(any(inside(r, (i + 0.5) * step, (j + 0.5) * step) for r in shapes.values()) for i in range(n) for j in range(n))
    assert facts(outline)[1] == pytest.approx(hit * step * step, abs=0.15)
    rings = R.ring_facts(R.trace(outline, "g"), "g").collect()
    assert sum(r["area_m2"] for r in rings) == pytest.approx(facts(outline)[1], abs=1e-6)
    assert R.coverage_check(outline, "g", 2.0).first()["open_vertices"] == 0


def test_rings_holes_and_text(spark):
    """A shell with a hole that holds an island, and a square that touches the shell in a corner."""
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    shapes = {"a": [ring(0, 10), ring(1, 9)], "b": [ring(3, 5)], "c": [ring(10, 12)]}
    _, outline = union(spark, shapes, 4.0)
    rings = R.trace(outline, "g")
    got = sorted((r["area_m2"], r["edge_count"]) for r in R.ring_facts(rings, "g").collect())
    assert got == [(-64.0, 4), (4.0, 4), (4.0, 4), (100.0, 4)]
    for r in rings.collect():
        assert 0 <= r["seq"] < 4
    assert R.shells(rings, "g", 4.0).filter("ring != shell").count() == 1
    shape = R.outline_shapes(outline, "g", 4.0).first()
    assert shape["rings"] == 4 and shape["geometry"].startswith("MULTIPOLYGON (((") and shape["geometry"].count("((") == 3
    assert shape["geometry"].count("), (") == 3  # The hole follows its own shell, clockwise.
    hole = next(p for p in shape["geometry"].split("((") if "1.0 1.0" in p).split("), (")[1].split(")")[0].split(", ")
    start = hole.index("1.0 1.0")
    assert hole[0] == hole[-1] and (hole[:-1] * 2)[start : start + 4] == ["1.0 1.0", "1.0 9.0", "9.0 9.0", "9.0 1.0"]


def test_open_outlines_are_an_error(spark):
    edges = P.edges(polygons(spark, a=SQUARE), "id").filter("x1 != 1 OR x2 != 1")
    with pytest.raises(ValueError, match="does not close"):
        R.trace(edges, "id")


def test_a_ring_of_a_hundred_thousand_edges(spark):
    n = 100_000
    at = lambda i: f"1000 * cos(2 * pi() * (({i}) % {n}) / {n})", lambda i: f"1000 * sin(2 * pi() * (({i}) % {n}) / {n})"
    edges = spark.range(n).selectExpr("'g' AS g", f"{at[0]('id')} AS x1", f"{at[1]('id')} AS y1", f"{at[0]('id + 1')} AS x2", f"{at[1]('id + 1')} AS y2")
    rings = R.trace(edges.repartition(8, "x1"), "g")
    fact = R.ring_facts(rings, "g").collect()
    assert len(fact) == 1 and fact[0]["edge_count"] == n and fact[0]["area_m2"] == pytest.approx(math.pi * 1e6, rel=1e-6)
    assert rings.agg(F.countDistinct("seq"), F.max("seq")).first()[:2] == (n, n - 1)
    apart = rings.alias("a").join(rings.alias("b"), F.expr(f"b.seq = (a.seq + 1) % {n}")).filter("a.x2 != b.x1 OR a.y2 != b.y1")
    assert apart.count() == 0
