import math
import random

import pytest
from pyspark.sql import functions as F

from hexloom.functions.measures import area_metrics, ascending_stops, clamp_top, cover_band, density_rank
from hexloom.functions.measures import suppress_artefacts
from hexloom.functions.numeric import nearest_int, round_to, safe_int
from hexloom.functions.text import label_codes, normalize_genus, normalize_species, surrogate_key
from hexloom.operators import histogram as H
from hexloom.operators import polygons as P
from hexloom.operators import proximity as X
from hexloom.operators import quantiles as U
from hexloom.plans import marts as M
from hexloom.plans import staging as S
from hexloom.sources.fixed_values import DISTRICT_NAMES, STAND_CODES

POINTS = "tree_id string, source string, genus_latin string, x double, y double"


def one(spark, sql):
    return spark.sql(f"SELECT {sql} AS v").first()["v"]


def test_safe_int(spark):
    texts = {"'1990'": 1990, "'1990.6'": 1991, "' 1990 '": 1990, "''": None, "'n/a'": None, "'NaN'": None,
             "'2.5'": 3, "'99999999999'": None, "CAST(NULL AS STRING)": None}
    for text, value in texts.items():
        assert one(spark, safe_int(text)) == value, text


def test_rounding(spark):
    assert one(spark, round_to("2.25D", 1)) == 2.3
    for large in (1e14, 1e18, 9.3e12):
        assert one(spark, round_to(f"{large!r}D", 6)) == large
    assert one(spark, round_to("double('Infinity')", 6)) == float("inf") and one(spark, round_to("cast(NULL as double)", 6)) is None
    assert one(spark, round_to("-2.25D", 1, signed=True)) == -2.3
    assert [one(spark, nearest_int(v)) for v in ("2.5D", "3.5D", "2.7D")] == [2, 4, 3]


def test_normalisers(spark):
    assert one(spark, normalize_genus("' Acer '", "'Tilia cordata'")) == "acer"
    assert one(spark, normalize_genus("'Unbekannt'", "' Tilia cordata'")) == "tilia"
    assert one(spark, normalize_genus("''", "CAST(NULL AS STRING)")) is None
    assert one(spark, normalize_species("'Acer rubrum \\'Red Sunset\\''")) == "acer rubrum"
    assert one(spark, normalize_species("CAST(NULL AS STRING)")) == ""
    assert one(spark, surrogate_key("'a'", "CAST(NULL AS STRING)")) is None
    assert one(spark, label_codes("'08'", DISTRICT_NAMES)) == "Neukölln"
    assert one(spark, label_codes("'99'", DISTRICT_NAMES)) == "Unknown"
    assert len(STAND_CODES) == 53 and sum(g == "" for *_, g in STAND_CODES) == 2


def flagged(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in rows.items()], POINTS)
    return {r["tree_id"] for r in X.flag_duplicates(frame).filter("is_potential_duplicate").collect()}


def test_duplicate_rules(spark):
    # Pairs are 100 m apart from each other.
    rows = {
        "near1": ("s", "Acer ", 0.0, 0.0), "near2": ("p", "acer", 2.0, 0.0),
        "far1": ("s", "acer", 99.9, 0.0), "far2": ("p", "acer", 101.901, 0.0),
        "same1": ("s", "acer", 200.0, 0.0), "same2": ("s", "acer", 201.0, 0.0),
        "null1": ("s", None, 300.0, 0.0), "null2": ("p", "acer", 301.0, 0.0),
        "blank1": ("s", "", 400.0, 0.0), "blank2": ("p", "acer", 401.0, 0.0),
        "other1": ("s", "tilia", 500.0, 0.0), "other2": ("p", "acer", 500.0, 0.0),
        "corner1": ("s", "acer", 607.9, 7.9), "corner2": ("p", "acer", 609.1, 8.9),
    }
    assert flagged(spark, rows) == {"near1", "near2", "null1", "null2", "corner1", "corner2"}


def test_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    rows = {
        str(i): (rng.choice("abc"), rng.choice([None, "", "g1", "g2", "g3"]), rng.uniform(0, 60), rng.uniform(0, 60))
        for i in range(500)
    }
    expected = {
        i for i, (s, g, x, y) in rows.items() for (t, h, u, v) in rows.values()
        if s != t and math.hypot(x - u, y - v) <= 2 and (g is None or h is None or g == h)
    }
    assert flagged(spark, rows) == expected


def test_duplicates_with_one_hot_place(spark):
    """A third of all rows on one spot and in one cell: results stay whole."""
    rng = random.Random(5)
    rows = {f"copy{i}": ("a", "g", 4.0, 4.0) for i in range(2000)}
    rows |= {f"crowd{i}": ("a", "g", 20 + rng.random() * 8, rng.random() * 8) for i in range(2000)}
    rows["partner"] = ("b", "g", 5.0, 4.0)
    got = flagged(spark, rows)
    assert got == {"partner", *(f"copy{i}" for i in range(2000))}


def test_histogram_ties_other_and_missing(spark):
    rows = [(1, g) for g in ["b", "a", "a", "b", "c", "", None]] + [(2, "z")]
    frame = spark.createDataFrame(rows, "k int, genus string")
    got = {r["k"]: r for r in H.category_histogram(frame, ["k"], "genus", k=2).collect()}
    assert (got[1]["tree_genus_1"], got[1]["tree_genus_2"]) == ("a", "b")
    assert got[1]["tree_genus_1_share"] == 40.0 and got[1]["tree_genus_other_count"] == 1
    assert got[2]["tree_genus_2"] is None and got[2]["tree_genus_other_share"] == 0.0
    total = H.category_histogram(frame, [], "genus", k=2).first()
    assert total["tree_genus_other_count"] == 2 and "k" not in total.asDict()


def test_profile_matches_its_parts(spark):
    rng = random.Random(2)
    rows = [
        (rng.choice([1, 1, 1, 2, 3]), rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", ""]), rng.choice("st"))
        for _ in range(3000)
    ]
    frame = spark.createDataFrame(rows, "k int, genus string, species string, source string")
    for r in H.point_profile(frame, ["k"], ["s", "t"], k=2).collect():
        mine = [row for row in rows if row[0] == r["k"]]
        genera = sorted({g for _, g, _, _ in mine if g}, key=lambda g: (-sum(m[1] == g for m in mine), g))
        species = sorted({s for *_, s, _ in mine if s}, key=lambda s: (-sum(m[2] == s for m in mine), s))
        assert r["tree_count"] == len(mine) == r["source_s"] + r["source_t"]
        assert (r["dominant_genus"], r["genus_count"]) == (genera[0], len(genera))
        assert (r["dominant_species"], r["species_count"]) == (species[0], len(species))
        shares = [r["tree_genus_1_share"], r["tree_genus_2_share"], r["tree_genus_other_share"]]
        assert sum(shares) == pytest.approx(100, abs=0.2)


def test_weighted_histogram_and_slots(spark):
    stands = spark.createDataFrame(
        [(1, " Ei", 60, "GKI", 30, None, 10), (2, "GKI", 0, "RO", 5, "??", 5)],
        "stand_id int, ba1 string, m1 int, ba2 string, m2 int, ba3 string, m3 int",
    )
    slots = H.unpivot_slots(stands, ["stand_id"], [("ba1", "m1"), ("ba2", "m2"), ("ba3", "m3")])
    assert sorted((r["stand_id"], r["code"], r["share"]) for r in slots.collect()) == [
        (1, "Ei", 60.0), (1, "GKI", 30.0), (2, "??", 5.0), (2, "RO", 5.0)
    ]
    row = H.weighted_histogram(slots, ["stand_id"], "code", "share", k=1).filter("stand_id = 1").first()
    assert (row["forest_genus_1"], row["forest_genus_1_share"], row["forest_genus_other_share"]) == ("Ei", 66.7, 33.3)


def test_exact_quantiles_with_hot_values(spark):
    rng = random.Random(9)
    values = [rng.uniform(-50, 5000) for _ in range(500)] + [7.5] * 1000
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 2.0)], "k string, v double")
    got = {(r["k"], r["fraction"]): r for r in U.rank_values(frame, "k", "v", [0.0, 0.3, 0.5, 0.95, 1.0]).collect()}
    ordered = sorted(values)
    for f in (0.0, 0.3, 0.5, 0.95, 1.0):
        p = f * (len(ordered) - 1)
        low, high = ordered[math.floor(p)], ordered[math.ceil(p)]
        assert got[("a", f)]["cont"] == pytest.approx(low + (high - low) * (p - math.floor(p)))
        assert got[("a", f)]["disc"] == ordered[max(math.ceil(f * len(ordered)) - 1, 0)]
    assert got[("b", 0.5)]["cont"] == 1.5 and got[("b", 0.5)]["disc"] == 1.0


def test_area_metrics_without_usable_land(spark):
    row = spark.sql("SELECT 100D AS a, 150D AS f, 3 AS t")
    m = row.selectExpr(*[f"{sql} AS {name}" for name, sql in area_metrics("a", "f", "t").items()]).first()
    assert m["tree_density_km2"] is None and m["forest_cover_pct"] == 100.0 and m["non_forest_area_km2"] == 0.0


def test_rank_and_bands(spark):
    q = "array(0D, 0D, 10D, 20D)"
    stops = f"{ascending_stops(clamp_top(q, '15'))}"
    assert one(spark, stops) == pytest.approx([0, 1e-6, 10, 15])
    ranks = [one(spark, density_rank(v, f"({stops})", "15")) for v in ("-1D", "0D", "5D", "12.5D", "99D")]
    assert ranks == pytest.approx([0, 0, 0.5, 5 / 6, 1], abs=1e-6)
    assert one(spark, density_rank("5D", "CAST(NULL AS ARRAY<DOUBLE>)", "20")) == 0.25
    assert [one(spark, cover_band(c)) for c in ("32.9D", "33D", "67D", "67.1D", "NULL")] == [
        "trees", "both", "both", "forest", "trees"
    ]
    assert one(spark, suppress_artefacts("900D", "90D", "800")) == 0
    assert one(spark, suppress_artefacts("700D", "90D", "800")) == 700
    assert one(spark, suppress_artefacts("700D", "96D", "800")) == 0


def test_staging_and_unify(spark):
    street = spark.createDataFrame(
        [(" 1 ", "Acer x", "Ahorn", "Acer", "Ahorn", "L", "1990.6", 30.0, 1.0, 2.0), ("2", "", "", "", "", "", "", 0.0, None, 2.0)],
        "id string, art_bot string, art_dtsch string, gattung string, gattung_deutsch string, art_gruppe string, "
        "pflanzjahr string, standalter double, x double, y double",
    )
    park = spark.createDataFrame(
        [("9", "Tilia", "Linde", "Tilia", 0.0, 1.0, 2.0)],
        "id string, baumart_bo string, baumart_de string, gattung_bo string, standalter double, x double, y double",
    )
    unified = S.unify_sources({"strassenbaeume": S.stage_points(street, "strassenbaeume"), "gruen_berlin": S.stage_points(park, "gruen_berlin")})
    rows = {r["tree_id"]: r for r in unified.collect()}
    assert set(rows) == {"1", "9"} and rows["1"]["planting_year"] == 1991
    assert rows["9"]["tree_age"] is None and rows["9"]["genus_german"] is None
    assert len({r["tree_uuid"] for r in rows.values()}) == 2


def test_dense_cells_test_no_pairs(spark):
    """A place full of two sources is decided by aggregates; only its rim is left for pairs."""
    rng = random.Random(3)
    rows = [(f"{i}", "ab"[i % 2], "g", 1000 + rng.random(), 1000 + rng.random()) for i in range(20_000)]
    frame = spark.createDataFrame(rows, POINTS)
    sites = X._sites(frame, "x", "y", "source", "genus_latin")
    assert X._crowded(sites, 2.0).count() == 20_000
    assert X.proximity_duplicates(frame, "tree_id").count() == 20_000


def test_flag_by_key(spark):
    rows = [("1", "a", "g", 0.0, 0.0), ("1", "a", "g", 900.0, 0.0), (None, "b", "g", 1.0, 0.0), (None, "c", "g", 500.0, 0.0), ("2", "c", "h", 0.0, 0.0)]
    got = X.flag_duplicates(spark.createDataFrame(rows, POINTS), id="tree_id").collect()
    assert sorted((r["x"], r["source"]) for r in got if r["is_potential_duplicate"]) == [(0.0, "a"), (900.0, "a")] and len(got) == 5


def test_quantiles_of_a_narrow_range(spark):
    """A million distinct values of one key within half a percent: no bucket to order exceeds the bound."""
    frame = spark.range(1_000_000).selectExpr("'k' AS k", "1e6D + id * 0.005D AS v", "1L AS n")
    rows, _ = U.rank_buckets(frame, "k", [0.0, 0.5, 0.95], bound=5000)
    assert rows.groupBy("k", "part").count().agg({"count": "max"}).first()[0] <= 5000
    got = {r["fraction"]: (r["cont"], r["disc"]) for r in U.rank_values(frame, "k", "v", [0.0, 0.5, 0.95], bound=5000).collect()}
    assert got[0.0] == (1e6, 1e6) and got[0.5][1] == pytest.approx(1e6 + 499_999 * 0.005) and got[0.5][0] == pytest.approx(1e6 + 499_999.5 * 0.005)
    odd = spark.createDataFrame([("k", v) for v in (float("inf"), -1e300, 0.0, -0.0, 5e-324, None, float("nan"), 1e300)], "k string, v double")
    assert {r["fraction"]: r["disc"] for r in U.rank_values(odd, "k", "v", [0.0, 1.0], bound=1).collect()} == {0.0: -1e300, 1.0: float("inf")}


def test_count_cube_holds_every_level(spark):
    """Cells, areas and the city from one pass equal direct counts; the point outside counts for the city alone."""
    square = [[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]]
    rings = [[[{"x": x + 100 * i, "y": y} for x, y in r] for r in square] for i in range(2)]
    areas = spark.createDataFrame(
        [(f"a{i}", r) for i, r in enumerate(rings)], "area_id string, rings array<array<struct<x:double,y:double>>>"
    )
    rows = [(float(7 * i % 200), float(3 * i % 100), "st"[i % 2], f"g{i % 3}", "s") for i in range(60)]
    rows += [(500.0, 500.0, "s", "g0", "s"), (None, 1.0, "s", "g0", "s")]
    points = spark.createDataFrame(rows, "x double, y double, source string, genus_latin string, species_latin string")
    cube = M.count_cube(points, [8, 9], P.edges(areas, "area_id"), "area_id", 50.0)

    def counted(df, *keys):
        return {tuple(r[:-1]): r[-1] for r in df.groupBy(*keys, "genus").agg(F.sum("n")).collect()}

    direct = M.located_points(points, [8, 9]).selectExpr("*", "1L AS n")
    assert counted(M.cell_counts(cube), "cell") == counted(direct, "cell")
    kept = [r for r in rows if r[0] is not None]
    by_area, by_genus = {}, {}
    for x, _, _, genus, _ in kept:
        by_genus[(genus,)] = by_genus.get((genus,), 0) + 1
        if x < 200:
            by_area[(f"a{int(x >= 100)}", genus)] = by_area.get((f"a{int(x >= 100)}", genus), 0) + 1
    assert counted(M.area_counts(cube, "area_id"), "area_id") == by_area
    assert counted(M.city_counts(cube)) == by_genus
    groups = spark.createDataFrame([("a0", "g"), ("a1", "g")], "area_id string, district string")
    assert sum(counted(M.area_counts(cube, "area_id", groups), "district").values()) == 60
    wide = H.point_profile(M.area_counts(cube, "area_id"), ["area_id"], ["s", "t"], weight="n")
    assert wide.agg(F.sum("tree_count"), F.sum("source_t")).first()[:] == (60, 30)
