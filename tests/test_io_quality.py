import json

import pytest

from hexloom.operators import quality as Q
from hexloom.operators import tiles as T
from hexloom.plans.marts import nest_summary
from hexloom.sources.export import export_layer, write_layers
from hexloom.sources.pages import ingest_feature_pages
from hexloom.session import shared_dir
from hexloom.sources.tables import load_lookup, load_table, materialize, reproject, source_catalogue
from hexloom.streaming.landing import fold_counts, keep_counts, kept_counts, land_pages, running_counts

PAGE = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 2.0]}, "properties": {"id": str(i)}}
        for i in range(3)
    ],
}


def test_drift_and_baseline(spark):
    counts = spark.createDataFrame(
        [("equal", 100), ("changed", 120), ("dropped", 9), ("stale", 5), ("new", 7)], "source string, new_count long"
    )
    baseline = spark.createDataFrame(
        [("equal", 100), ("changed", 100), ("dropped", 100), ("stale", 50), ("missing", 10)], "source string, count long"
    ).selectExpr("*", "timestamp'2024-01-01' AS last_checked")
    drift = Q.source_drift(counts, baseline, excluded=("stale",))
    status = {r["source"]: r["status"] for r in drift.collect()}
    assert status == {
        "equal": "ok", "changed": "changed", "dropped": "suspicious", "stale": "kept", "missing": "error", "new": "changed",
    }
    held = {r["source"]: r["count"] for r in Q.advance_baseline(drift, baseline).collect()}
    assert held == {"equal": 100, "changed": 100, "dropped": 100, "stale": 50, "missing": 10}
    fine = drift.filter("status NOT IN ('suspicious', 'error')")
    moved = {r["source"]: r["count"] for r in Q.advance_baseline(fine, baseline).collect()}
    assert moved["changed"] == 120 and moved["stale"] == 50 and moved["new"] == 7


def test_expectations_and_profile(spark):
    frame = spark.createDataFrame([("a", 1), ("a", None), (None, 2), (None, None)], "s string, n int")
    assert [r["failures"] for r in Q.expect_not_null(frame, ["s", "n"]).collect()] == [2, 2]
    assert Q.expect_unique(frame, "s").first()["failures"] == 1
    assert Q.expect_unique(frame, "n").first()["failures"] == 0
    assert Q.expect_in_set(frame, "s", ["b"]).first()["failures"] == 1
    assert Q.expect_min_rows(frame, 4).first()["failures"] == 1
    assert Q.expect_min_rows(frame, 3).first()["failures"] == 0
    profile = {r["column"]: r for r in Q.profile_table(frame, ["s", "n"], high_null_pct=40.0).collect()}
    assert profile["s"]["null_pct"] == 50.0 and profile["s"]["high_null"]


def test_pages_batch_and_resumable_stream(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "p0.json").write_text(json.dumps(PAGE, indent=1))
    rows = ingest_feature_pages(spark, str(pages), "id string")
    assert sorted((r["id"], r["x"], r["geom_type"]) for r in rows.collect())[2] == ("2", 2.0, "Point")
    table, progress = str(tmp_path / "table"), str(tmp_path / "progress")
    land_pages(spark, str(pages), table, progress, "id string").awaitTermination()
    (pages / "p1.json").write_text(json.dumps(PAGE))
    for expected in (6, 6):
        land_pages(spark, str(pages), table, progress, "id string").awaitTermination()
        assert spark.read.parquet(table).count() == expected


def test_polygon_pages(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    for kind, coordinates in (("Polygon", square), ("MultiPolygon", [square, square])):
        page = {"features": [{"geometry": {"type": kind, "coordinates": coordinates}, "properties": {"id": "a"}}]}
        path = tmp_path / f"{kind}.json"
        path.write_text(json.dumps(page))
        row = ingest_feature_pages(spark, str(path), "id string", kind).first()
        assert len(row["rings"] if kind == "Polygon" else row["parts"]) == len(coordinates)


def test_running_counts_counts_each_key_once(spark, tmp_path):
    spark.createDataFrame([("u1", 1), ("u1", 1), ("u2", 1)], "tree_uuid string, cell long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tree_uuid string, cell long").parquet(str(tmp_path / "in"))
    query = (
        running_counts(stream, "tree_uuid", ["cell"]).writeStream.format("memory").queryName("running")
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("running").first()["tree_count"] == 2


def test_kept_counts_survive_replays_and_folding(spark, tmp_path):
    landed, table, progress = (str(tmp_path / n) for n in ("landed", "counts", "progress"))
    schema = "tree_uuid string, cell long"

    def deliver(*rows):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(schema).parquet(landed)
        keep_counts(stream, "tree_uuid", ["cell"], table, progress).awaitTermination()
        return {r["cell"]: r["tree_count"] for r in kept_counts(spark, table, ["cell"]).collect()}

    with pytest.raises(ValueError, match="no counts"):
        kept_counts(spark, table, ["cell"])
    assert deliver(("u1", 1), ("u1", 1), ("u2", 1), ("u3", 2)) == {1: 2, 2: 1}
    assert deliver(("u2", 1), ("u4", 2), ("u5", None)) == {1: 2, 2: 2, None: 1}
    assert deliver() == {1: 2, 2: 2, None: 1}
    # A batch that runs again overwrites its own part: forget that the second one was finished.
    last = max((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert deliver() == {1: 2, 2: 2, None: 1}
    fold_counts(spark, table, ["cell"])
    # A base that was not written to its end does not count.
    (tmp_path / "counts" / "base" / "upto=99").mkdir()
    assert deliver(("u6", 2)) == {1: 2, 2: 3, None: 1}
    fold_counts(spark, table, ["cell"])
    assert {r["cell"]: r["tree_count"] for r in kept_counts(spark, table, ["cell"]).collect()} == {1: 2, 2: 3, None: 1}


def test_tables_and_lookup(spark, tmp_path, sf):
    assert load_table(spark, f"{sf}/part.parquet", "part_view").count() == spark.table("part_view").count()
    (tmp_path / "codes.csv").write_text("ba_code,deuts,genus_latin,notes\n01,Eiche,Quercus,\nBlö,Blöße,,x\n")
    rows = {r["ba_code"]: r["genus_latin"] for r in load_lookup(spark, str(tmp_path / "codes.csv")).collect()}
    assert rows == {"01": "Quercus", "Blö": ""}
    assert load_lookup(spark).count() == 53 and source_catalogue(spark).count() == 5
    frame = spark.range(10)
    for mode, path in (("view", None), ("cache", None), ("table", str(tmp_path / "t"))):
        assert materialize(frame, mode, f"m_{mode}", path).count() == spark.table(f"m_{mode}").count() == 10
    with pytest.raises(ValueError):
        materialize(frame, "other", "m")


def test_reproject_only_marked_rows(spark):
    frame = spark.createDataFrame([(15.0, 50.0, "EPSG:4326"), (1.0, 2.0, None)], "x double, y double, crs string")
    a, b = reproject(frame).collect()
    assert (a["x"], a["y"]) == pytest.approx((500000.0, 5538630.7027), abs=1e-3)
    assert (b["x"], b["y"], b["crs"]) == (1.0, 2.0, "EPSG:25833")


def test_export_and_tiles(spark, tmp_path):
    frame = spark.createDataFrame([(i, "POINT (0 0)") for i in range(5)], "id int, geometry string")
    write_layers([export_layer(frame, "trees", ["id"])], str(tmp_path / "out"))
    with pytest.raises(Exception, match="no archive for layer unknown"):
        write_layers([export_layer(frame, "unknown")], str(tmp_path / "lost"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["archive"], r["layer"]) for r in out.collect()} == {("trees", "trees")} and out.count() == 5
    points = spark.createDataFrame([(i, 13.4 + i * 1e-6, 52.5) for i in range(9)], "id int, lon double, lat double")
    tiles = T.tile_assign(points, 0, 2)
    assert {(r["z"], r["tx"], r["ty"]) for r in tiles.collect()} == {(0, 0, 0), (1, 1, 0), (2, 2, 1)}
    thin = T.tile_thin(tiles, 4, "id")
    assert sorted(r["id"] for r in thin.filter("z = 1").collect()) == [0, 1, 2, 3]


def test_nest_summary_drops_empty_slots(spark):
    columns = ["5L AS tree_count", "1L AS genus_count", "1D AS berlin_area_km2", "1D AS forest_area_km2",
               "1D AS non_forest_area_km2", "1D AS forest_cover_pct", "1D AS tree_density_km2"]
    for i in range(1, 11):
        name = "'acer'" if i == 1 else "CAST(NULL AS STRING)"
        columns += [f"{name} AS tree_genus_{i}", f"5L AS tree_genus_{i}_count", f"100D AS tree_genus_{i}_share"]
    for i in range(1, 6):
        columns += [f"CAST(NULL AS STRING) AS forest_genus_{i}", f"CAST(NULL AS DOUBLE) AS forest_genus_{i}_share"]
    columns += ["0L AS tree_genus_other_count", "0D AS tree_genus_other_share", "CAST(NULL AS DOUBLE) AS forest_genus_other_share",
                "1 AS density_res9_p50", "2 AS density_res9_p95", "'[1.0,2.5]' AS density_res9_quantiles"]
    row = nest_summary(spark.sql("SELECT " + ", ".join(columns)), ["res9"]).first()
    assert [g["genus"] for g in row["top_genera"]] == ["acer"] and row["forest_genera"] == []
    assert row["density_ranges"]["res9"]["quantiles"] == [1.0, 2.5]


def test_unreadable_page_fails(spark, tmp_path):
    page = '{"type": "FeatureCollection", "features": []}'
    (tmp_path / "a.json").write_text(page)
    (tmp_path / "b.json").write_text(page[:30])
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest_feature_pages(spark, str(tmp_path), "id string").collect()


def test_tiles_at_the_edge_of_the_map(spark):
    frame = spark.createDataFrame([(180.0, 90.0), (-180.0, -90.0)], "lon double, lat double")
    tiles = [(r["tx"], r["ty"]) for r in T.tile_assign(frame, 3, 3).orderBy("lon").collect()]
    assert tiles == [(0, 7), (7, 0)]


def test_shared_folder_is_asked_for(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
