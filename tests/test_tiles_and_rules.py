"""Density thinning of tiles and data-quality rules in one scan."""

import random
from collections import Counter, defaultdict

import pytest

from hexloom.operators import quality as Q
from hexloom.operators import tiles as T

SCHEMA = "id long, lon double, lat double"


def test_dense_features_go_first(spark):
    """A crowd in one street loses features before lone ones around it do, at every zoom."""
    rng = random.Random(1)
    crowd = [(i, 13.4 + rng.random() * 1e-4, 52.5 + rng.random() * 1e-4) for i in range(300)]
    lone = [(1000 + i, 13.0 + 0.05 * i, 52.2 + 0.04 * (i * 7 % 20)) for i in range(20)]
    kept, report = T.tile_thin_densest(spark.createDataFrame(crowd + lone, SCHEMA), "id", 4, 12, 25)
    rows = kept.collect()
    for z in range(4, 13):
        per_tile = Counter((r["tx"], r["ty"]) for r in rows if r["z"] == z)
        assert max(per_tile.values()) <= 25
        assert sum(r["id"] >= 1000 for r in rows if r["z"] == z) == 20
    by_zoom = defaultdict(set)
    for r in rows:
        by_zoom[r["z"]].add(r["id"])
    assert all(by_zoom[z] <= by_zoom[z + 1] for z in range(4, 12))
    totals = report.groupBy("z").agg({"kept": "sum", "dropped": "sum"}).collect()
    assert all(r["sum(kept)"] + r["sum(dropped)"] == 320 for r in totals)


def test_one_place_with_very_many_features(spark):
    rows = spark.range(20_000).selectExpr("id", "13.4D AS lon", "52.5D AS lat")
    kept, report = T.tile_thin_densest(rows, "id", 6, 8, 10)
    assert {r["id"] for r in kept.collect()} == set(range(10)) and kept.count() == 30
    assert {(r["kept"], r["dropped"]) for r in report.collect()} == {(10, 19_990)}


def test_no_features(spark):
    kept, report = T.tile_thin_densest(spark.createDataFrame([], SCHEMA), "id", 6, 8, 10)
    assert kept.count() == 0 and report.count() == 0


def test_tile_numbers_match_the_plain_assignment(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(i, rng.uniform(-179, 179), rng.uniform(-84, 84)) for i in range(200)], SCHEMA)
    kept, _ = T.tile_thin_densest(points, "id", 5, 17, 1000)
    plain = T.tile_assign(points, 5, 17).select("z", "tx", "ty", "id")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, plain.collect()))


def test_all_rules_from_one_scan(spark, sf, tmp_path):
    rows = [("a", 1, "x"), ("a", None, "it's"), ("b", 2, None), (None, 2, "y"), (None, 3, "z")]
    spark.createDataFrame(rows, "k string, n int, s string").write.parquet(str(tmp_path / "t"))
    checked = Q.expect_all(
        spark.read.parquet(str(tmp_path / "t")), ["k", "n", "s"], ["k", "n"], [("s", ["x", "it's"]), ("n", ["1", "2", "3"])], 5
    )
    got = sorted((r["check"], r["column"], r["failures"]) for r in checked.collect())
    assert got == sorted([
        ("not_null", "k", 2), ("not_null", "n", 1), ("not_null", "s", 1), ("unique", "k", 1), ("unique", "n", 1),
        ("accepted_values", "s", 2), ("accepted_values", "n", 0), ("min_rows", "*", 1),
    ])
    assert checked._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2  # Initial and final plan.
    empty = spark.createDataFrame([], "k string, n int, s string")
    assert {r["check"]: r["failures"] for r in Q.expect_all(empty, ["k"], ["n"], [("s", ["x"])], 0).collect()} == {
        "not_null": 0, "unique": 0, "accepted_values": 0, "min_rows": 1,
    }


@pytest.mark.parametrize("name", ["xxhash", "public_tokenizers", "corpus_pipeline"])
def test_core_queries_survive_a_missing_library(monkeypatch, name):
    import importlib
    import sys

    import __spark_entry__ as entry

    for module in [m for m in sys.modules if m.startswith("hexloom.llm") or m in ("corpus_pipeline", name)]:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setitem(sys.modules, name, None)
    with pytest.warns(UserWarning, match="left out"):
        importlib.reload(entry)
    assert len(entry.queries()) > 60 and not any(q.startswith("op1") for q in entry.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_tiles_of_shapes(spark):
    """A slanted shape with a hole: exactly the tiles it overlaps, by a fine raster; shares add up to its area."""
    from geo import inside, polygons
    from hexloom.operators import polygons as P

    shape = [
        [(380000.0, 5810000.0), (386500.0, 5811200.0), (385000.0, 5816500.0), (379000.0, 5814000.0)],
        [(382000.0, 5811500.0), (382000.0, 5813800.0), (384600.0, 5813800.0), (384600.0, 5811500.0)],
    ]
    edges = P.edges(polygons(spark, s=shape), "id")
    tiles = T.tile_shapes(edges, "id", 12, 15).collect()
    assert all(0 < t["share"] <= 1 + 1e-9 for t in tiles)
    sums = Counter()
    for t in tiles:
        sums[t["z"]] += t["share"] / 4 ** t["z"]
    assert max(sums.values()) == pytest.approx(min(sums.values()), rel=1e-9)
    dots = [(380000.0 + i * 20 - 2000, 5809000.0 + j * 20) for i in range(460) for j in range(400)]
    dots = [(x, y) for x, y in dots if inside(shape, x, y)]
    from hexloom.functions.projection import tile_x, tile_y, utm33_to_lonlat

    hit = spark.createDataFrame(dots, "x double, y double").selectExpr(f"{utm33_to_lonlat('x', 'y')} AS p").selectExpr(
        f"{tile_x('p.lon', '15')} AS tx", f"{tile_y('p.lat', '15')} AS ty"
    ).groupBy("tx", "ty").count().collect()
    got = {(t["tx"], t["ty"]): t["share"] for t in tiles if t["z"] == 15}
    assert {(r["tx"], r["ty"]) for r in hit} <= set(got)
    assert all(share < 0.01 for place, share in got.items() if place not in {(r["tx"], r["ty"]) for r in hit})


def test_a_continental_box(spark):
    """Rows of tiles spread over many rows of the job; all tiles inside are whole."""
    from geo import polygons
    from hexloom.operators import polygons as P

    box = [[(0.0, 5500000.0), (900000.0, 5500000.0), (900000.0, 6400000.0), (0.0, 6400000.0)]]
    tiles = T.tile_shapes(P.edges(polygons(spark, b=box), "id"), "id", 10, 10)
    whole = tiles.filter("share > 1 - 1e-9").count()
    assert 1000 < whole < tiles.count()
