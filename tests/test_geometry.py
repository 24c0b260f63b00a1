import random

import pytest
from pyspark.sql import functions as F

from geo import A1, A2, B1, B2, SQUARE, inside, polygons, shift
from hexloom.functions.hexgrid import edge_length, hex_boundary, hex_cell, hex_center
from hexloom.functions.projection import lonlat_to_utm33, utm33_to_lonlat
from hexloom.operators import cells as C
from hexloom.operators import outlines as R
from hexloom.operators import overlay as O
from hexloom.operators import polygons as P


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_area_and_centroid_with_any_ring_direction(spark):
    backwards = [list(reversed(ring)) for ring in A1]
    frame = polygons(spark, sq=SQUARE, l=[A1[0]], hole=A1, back=backwards, closed=[SQUARE[0] + SQUARE[0][:1]])
    edges = P.edges(frame, "id")
    assert as_dict(P.polygon_area(edges, "id"), "id", "area_m2") == {
        "sq": 1.0, "l": 64.0, "hole": 61.0, "back": 61.0, "closed": 1.0,
    }
    centre = {r["id"]: (r["x"], r["y"]) for r in P.polygon_centroid(edges, "id").collect()}
    assert centre["sq"] == pytest.approx((0.5, 0.5))
    # 64 at (3.875, 3.875) less the hole of 3 at (2, 1.75)
    assert centre["hole"] == pytest.approx(((64 * 3.875 - 3 * 2) / 61, (64 * 3.875 - 3 * 1.75) / 61))


@pytest.mark.parametrize("side", [1.0, 2.5, 7.0, 100.0])
@pytest.mark.parametrize("offset", [(0, 0), (380000.25, 5810000.5)])
def test_overlap_area_for_any_bucket_size(spark, side, offset):
    a = polygons(spark, A1=shift(A1, *offset), A2=shift(A2, *offset))
    b = polygons(spark, B1=shift(B1, *offset), B2=shift(B2, *offset))
    pairs = O.polygon_overlap_area(
        P.edges(a, "id").withColumnRenamed("id", "a"), "a", P.edges(b, "id").withColumnRenamed("id", "b"), "b", side
    )
    got = {(r["a"], r["b"]): r["area_m2"] for r in pairs.collect()}
    assert got[("A1", "B1")] == pytest.approx(20.176966, abs=1e-5)
    assert got[("A1", "B2")] == pytest.approx(6.0, abs=1e-6)
    assert got[("A2", "B1")] == pytest.approx(19.686025, abs=1e-5)
    assert got[("A2", "B2")] == pytest.approx(9.0, abs=1e-6)


@pytest.mark.parametrize("side", [1.0, 3.0, 50.0])
def test_slabs_keep_the_area(spark, side):
    edges = P.edges(polygons(spark, A1=A1, A2=A2, B1=B1, B2=B2), "id")
    whole = as_dict(P.polygon_area(edges, "id"), "id", "area_m2")
    cut = as_dict(P.slab_area(P.cut_to_grid(edges, "id", side), "id"), "id", "area_m2")
    assert cut == pytest.approx(whole)


def test_touching_squares_do_not_overlap_and_dissolve(spark):
    frame = polygons(spark, a=SQUARE, b=shift(SQUARE, 1, 0))
    edges = P.edges(frame, "id")
    other = edges.withColumnRenamed("id", "other")
    pairs = O.polygon_overlap_area(edges, "id", other, "other", 2.0)
    assert {(r["id"], r["other"]) for r in pairs.collect()} == {("a", "a"), ("b", "b")}
    outline = R.dissolve(edges.withColumn("g", F.lit(1)), "g")
    assert outline.count() == 6
    assert R.coverage_check(outline, "g").first()["open_vertices"] == 0
    assert P.polygon_area(P.with_origin(outline, "g"), "g").first()["area_m2"] == 2.0


def test_coverage_check_reports_open_outlines(spark):
    edges = P.edges(polygons(spark, a=SQUARE), "id").filter("x1 != 1 OR x2 != 1")
    assert R.coverage_check(edges, "id").first()["open_vertices"] == 2


@pytest.mark.parametrize("side", [0.7, 3.0, 40.0])
def test_points_in_polygons_against_even_odd(spark, side):
    shapes = {"A1": A1, "A2": A2, "B1": B1, "B2": B2}
    rng = random.Random(7)
    points = [(i, rng.uniform(-4, 13), rng.uniform(-5, 11)) for i in range(400)]
    frame = spark.createDataFrame(points, "p long, x double, y double")
    edges = P.edges(polygons(spark, **shapes), "id")
    expected = {(p, name) for p, x, y in points for name, rings in shapes.items() if inside(rings, x, y)}
    for limit in ("10m", "-1"):  # broadcast and shuffled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = O.points_in_polygons(frame, edges, "id", side).collect()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {(r["p"], r["id"]) for r in got} == expected


@pytest.mark.parametrize("side, sites", [(0.7, 32), (3.0, 2), (40.0, 0.05), (40.0, 0.0001)])
def test_counted_points_equal_the_pairs(spark, monkeypatch, side, sites):
    """Also for points on outlines, on cell borders and repeated ones, and outlines that cross themselves."""
    monkeypatch.setattr(O, "SITES_PER_CELL", sites)
    shapes = {"A1": A1, "A2": A2, "B1": B1, "B2": B2, "X": [[(0, 0), (8, 8), (8, 0), (0, 8)]], "S": SQUARE}
    rng = random.Random(3)
    points = [(rng.uniform(-4, 13), rng.uniform(-5, 11)) for _ in range(600)]
    points += [(x / 4, y / 4) for x in range(-8, 50) for y in range(-8, 48)] + [(2.5, 2.5)] * 20
    frame = spark.createDataFrame(points, "x double, y double")
    edges = P.edges(polygons(spark, **shapes), "id")
    pairs = O.points_in_polygons(frame, edges, "id", side).groupBy("id").count()
    counts = O.points_in_polygons(frame, edges, "id", side, counted=True).groupBy("id").agg(F.sum("n").alias("count"))
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in pairs.collect()}


def test_points_of_cells_inside_are_not_paired(spark, monkeypatch):
    """Every point met every polygon over its bucket, so pairs grew with points times polygons."""
    monkeypatch.setattr(O, "SITES_PER_CELL", 1)
    frame = spark.range(4096).selectExpr("id % 64 + 0.5D AS x", "int(id / 64) + 0.5D AS y")
    shapes = {f"s{i}": [[(i, i), (60 - i, i), (60 - i, 60 - i), (i, 60 - i)]] for i in range(10)}
    edges = P.edges(polygons(spark, **shapes), "id")
    counts = O.points_in_polygons(frame, edges, "id", 64.0, counted=True)
    assert {r["id"]: r["n"] for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect()} == {f"s{i}": (60 - 2 * i) ** 2 for i in range(10)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    # Whole columns are told by running counts; no pair meets on the bucket alone.
    assert "below" in plan and "_bx" not in plan


def test_counted_points_of_a_bucket_in_parts(spark, monkeypatch):
    """A bucket of many points and pieces is several units; lines over it were one row a column of cells."""
    monkeypatch.setattr(O, "GROUP", 40)
    monkeypatch.setattr(O, "STEP", 100)
    monkeypatch.setattr(O, "SITES_PER_CELL", 4)
    rng = random.Random(11)
    frame = spark.createDataFrame([(rng.uniform(-1, 11), rng.uniform(-1, 11)) for _ in range(500)] + [(5.0, 5.0)] * 90, "x double, y double")
    shapes = {f"s{i}": [[(i % 7, i % 5), (9, i % 3), (10 - i % 4, 9), (i % 6, 10)]] for i in range(60)}
    edges = P.edges(polygons(spark, **shapes), "id")
    pairs = O.points_in_polygons(frame, edges, "id", 16.0).groupBy("id").count()
    counts = O.points_in_polygons(frame, edges, "id", 16.0, counted=True)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "xb#" in plan and "running" not in plan
    assert {tuple(r) for r in counts.groupBy("id").agg(F.sum("n")).collect()} == {tuple(r) for r in pairs.collect()}


def test_points_on_shared_edges_belong_to_one_square(spark):
    edges = P.edges(
        polygons(spark, **{f"{i}{j}": shift(SQUARE, i, j) for i in range(3) for j in range(3)}), "id"
    )
    grid = [(float(x) / 2, float(y) / 2) for x in range(7) for y in range(7)]
    points = spark.createDataFrame(grid, "x double, y double")
    got = O.points_in_polygons(points, edges, "id", 1.0).groupBy("x", "y").count().collect()
    assert {(r["x"], r["y"]) for r in got} == {(x, y) for x, y in grid if x < 3 and y < 3}
    assert all(r["count"] == 1 for r in got)


def test_clip_and_trapezoids(spark):
    a = P.edges(polygons(spark, A1=A1, A2=A2), "id")
    b = P.edges(polygons(spark, B1=B1), "id").withColumnRenamed("id", "b")
    for side in (2.0, 30.0):
        slabs = O.clip_to_boundary(a, "id", b, "b", side)
        area = as_dict(P.slab_area(slabs, "id"), "id", "area_m2")
        assert area == pytest.approx({"A1": 20.176966, "A2": 19.686025}, abs=1e-5)
        traps = O.trapezoid_rings(O.slab_trapezoids(slabs, "id"), "id", side).selectExpr("uuid() AS t", "id", "array(ring) AS rings")
        parts = P.edges(traps, "t", keep=("id",)).groupBy("id").agg(
            F.expr("sum((x1 - x2) * (y1 + y2 - 2 * oy) / 2) AS area_m2")
        )
        assert as_dict(parts, "id", "area_m2") == pytest.approx(area, abs=1e-5)


def test_hex_cell_is_the_nearest_centre(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(370000, 420000), rng.uniform(5790000, 5840000)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "x double, y double").selectExpr("*", f"{hex_cell('x', 'y', 9)} AS cell")
    near = C.hex_disk(frame, "cell", 1, "n").selectExpr(
        "x", "y", "cell", "n", f"{hex_center('n')} AS c"
    ).selectExpr("*", "hypot(x - c.x, y - c.y) AS d")
    best = near.groupBy("x", "y", "cell").agg(F.expr("min_by(n, d) AS n"), F.expr("min(d) AS d"))
    assert best.filter("n != cell").count() == 0
    assert best.agg(F.max("d")).first()[0] <= edge_length(9)


def test_neighbouring_cells_share_corners_exactly(spark):
    base = spark.createDataFrame([(385000.0, 5815000.0)], "x double, y double").selectExpr(
        f"{hex_cell('x', 'y', 8)} AS cell"
    )
    patch = C.hex_disk(base, "cell", 2, "n").selectExpr("n AS cell")
    outline = R.cancel_shared(C.hex_edges(patch).withColumn("g", F.lit(1)), "g")
    assert outline.count() == 30  # a disk of radius two has 6 * 5 border sides
    corners = patch.selectExpr(f"explode({hex_boundary('cell')}) AS p").distinct().count()
    assert corners == 54


def test_cover_modes(spark):
    big = [[(380000, 5810000), (383000, 5810000), (383000, 5812000), (380000, 5812000)]]
    edges = P.edges(polygons(spark, big=big), "id")
    centre = {r["cell"] for r in C.hex_cover(edges, "id", 9, "center").collect()}
    ring = {r["cell"] for r in C.hex_cover(edges, "id", 9, "center+1").collect()}
    touch = {r["cell"] for r in C.hex_cover(edges, "id", 9, "touch").collect()}
    assert centre < touch <= ring
    assert len(centre) == pytest.approx(6_000_000 / (edge_length(9) ** 2 * 1.5 * 3**0.5), rel=0.05)
    with pytest.raises(ValueError):
        C.hex_cover(edges, "id", 9, "other")


def test_touch_finds_small_polygons_the_centre_rule_misses(spark):
    tiny = [[(380010, 5810010), (380012, 5810010), (380012, 5810012)]]
    edges = P.edges(polygons(spark, tiny=tiny), "id")
    assert C.hex_cover(edges, "id", 7, "touch").count() == 1


def test_closing_fills_gaps_and_keeps_cells(spark):
    base = spark.createDataFrame([(385000.0, 5815000.0)], "x double, y double").selectExpr(
        f"{hex_cell('x', 'y', 10)} AS cell"
    )
    disk = C.hex_disk(base, "cell", 2, "n").selectExpr("n AS cell")
    holed = disk.join(base, "cell", "left_anti")
    closed = {r["cell"] for r in C.morph_close(holed, 1).collect()}
    assert closed == {r["cell"] for r in disk.collect()}
    assert C.morph_close(base, 3).count() == 1


def test_projection_round_trip_and_known_point(spark):
    frame = spark.createDataFrame([(380000.0, 5810000.0), (415000.0, 5840000.0)], "x double, y double")
    there = frame.selectExpr("*", f"{utm33_to_lonlat('x', 'y')} AS p")
    back = there.selectExpr("x", "y", "p.lon AS lon", "p.lat AS lat", f"{lonlat_to_utm33('p.lon', 'p.lat')} AS q")
    for r in back.collect():
        assert abs(r["q"]["x"] - r["x"]) < 1e-4 and abs(r["q"]["y"] - r["y"]) < 1e-4
    # On the central meridian x is the false easting and the meridian is straight.
    mid = spark.sql(f"SELECT {utm33_to_lonlat('500000D', '5538630.702867D')} AS p").first()["p"]
    assert mid["lon"] == pytest.approx(15.0) and mid["lat"] == pytest.approx(50.0, abs=1e-7)


def test_clip_rings_to_cell(spark):
    shape = [[(380000, 5810000), (380900, 5810000), (380900, 5810700), (380400, 5810300), (380000, 5810700)]]
    edges = P.edges(polygons(spark, s=shape), "id")
    cover = C.hex_cover(edges, "id", 9, "touch").join(polygons(spark, s=shape), "id")
    clipped = O.clip_rings_to_cell(cover, "id")
    keyed = clipped.selectExpr("cell", "rings")
    total = P.polygon_area(P.edges(keyed, "cell"), "cell").agg(F.sum("area_m2")).first()[0]
    assert total == pytest.approx(P.polygon_area(edges, "id").first()["area_m2"], rel=1e-9)
