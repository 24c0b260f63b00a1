"""One query per operator over the driver tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions.hexgrid import cell_string, hex_boundary, hex_cell, hex_center
from hexloom.functions.measures import cover_band
from hexloom.functions.numeric import round_to
from hexloom.functions.projection import utm33_to_lonlat
from hexloom.functions.text import normalize_genus, normalize_species
from hexloom.functions.wkt import point_wkt, polygon_wkt
from hexloom.operators import cells as C
from hexloom.operators import histogram as H
from hexloom.operators import outlines as R
from hexloom.operators import overlay as O
from hexloom.operators import polygons as P
from hexloom.operators import proximity as X
from hexloom.operators import quality as Q
from hexloom.operators import quantiles as U
from hexloom.operators import tiles as T
from hexloom.plans import forests as W
from hexloom.plans import layers as L
from hexloom.plans import marts as M
from hexloom.plans import staging as S
from hexloom.session import fresh_path, settle
from hexloom.sources.binary import point_binary, polygon_binary, read_geometry
from hexloom.sources.export import export_layer, write_layers
from hexloom.sources.fixed_values import LAYER_ARCHIVES, POINT_SOURCES
from hexloom.sources.pages import ingest_feature_pages
from hexloom.sources.tables import load_lookup, load_table, materialize, reproject
from hexloom.streaming.landing import fold_counts, keep_counts, land_pages
from hexloom.streaming.landing import kept_counts as counted
from hexloom.workload import derived as D

SOURCES = ("A", "N", "R")
RES = 9
SIDE = 250.0
LEVELS = ("res6", "res7", "res8", "res9", "bezirke", "ortsteile")


def area_edges(spark: SparkSession, sf: str) -> DataFrame:
    return P.edges(D.areas(spark, sf), "area_id")


def stand_edges(spark: SparkSession, sf: str) -> DataFrame:
    return P.edges(D.stands(spark, sf), "stand_id")


def city(spark: SparkSession, sf: str) -> DataFrame:
    return S.city_outline(area_edges(spark, sf))


def districts(spark: SparkSession, sf: str) -> DataFrame:
    """District outlines and names from the neighbourhood key."""
    staged = S.stage_neighbourhoods(D.areas(spark, sf).withColumnRenamed("area_name", "nam"))
    return S.district_outlines(P.edges(staged, "ortsteil_code", keep=("bezirk_code",)))


def cells_d(spark: SparkSession, sf: str, res: int = RES) -> DataFrame:
    return M.located_points(D.points_d(spark, sf), [res])


def stage_unify(spark, sf):
    staged = {s: S.stage_points(df, s) for s, df in D.raw_inventories(spark, sf).items()}
    return S.unify_sources(staged)


def unified_points(spark, sf):
    points = S.unified_points(D.raw_inventories(spark, sf))
    return points.select("tree_uuid", "source", "genus_latin", "is_potential_duplicate")


def normalize_category(spark, sf):
    return (
        D.points_d(spark, sf)
        .selectExpr(
            f"{normalize_genus('genus_latin', 'species_latin')} AS genus",
            f"{normalize_species('species_latin')} AS species",
        )
        .groupBy("genus", "species")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def hex_count(spark, sf):
    return (
        cells_d(spark, sf)
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("tree_count"), F.count_distinct("genus").alias("genus_count"))
        .selectExpr(f"{cell_string('cell')} AS h3_index", "tree_count", "genus_count")
    )


def hex_histogram_top10(spark, sf):
    return H.category_histogram(cells_d(spark, sf), ["cell"], "genus")


def city_histogram_top10(spark, sf):
    return H.category_histogram(M.normalized_points(D.points_d(spark, sf)), [], "genus")


def dominant_value(spark, sf):
    return H.dominant_value(cells_d(spark, sf), ["cell"], "genus", "dominant_genus")


def dominant_share(spark, sf):
    return H.dominant_share(cells_d(spark, sf), ["cell"], "species", "dominant_species_pct")


def source_mix(spark, sf):
    return H.source_mix(cells_d(spark, sf), ["cell"], "source", SOURCES)


def share_of_total(spark, sf):
    shares = H.share_of_total(cells_d(spark, sf), ["cell"], "genus")
    return shares.selectExpr("cell", "genus", "n", f"{round_to('share', 9)} AS share")


def proximity_dups(spark, sf):
    return X.proximity_duplicates(D.points_u(spark, sf), "tree_id")


def duplicate_ids(spark, sf):
    """The flag goes by key: some ids are missing, others stand on many rows."""
    points = D.points_u(spark, sf).withColumn(
        "tree_id", F.expr("CASE WHEN tree_id % 89 = 0 THEN NULL WHEN tree_id % 83 = 0 THEN '7' ELSE tree_id END")
    )
    flagged = X.flag_duplicates(points, id="tree_id")
    return flagged.groupBy("tree_id", "source", "is_potential_duplicate").agg(F.expr("count(1) AS n"))


def crowded_dups(spark, sf):
    """Thousands of points of all sources within a few metres."""
    points = D.points_u(spark, sf).withColumns({c: F.expr(f"{c} - 0.99D * ({c} - {o})") for c, o in (("x", 380000), ("y", 5810000))})
    return X.proximity_duplicates(points, "tree_id")


def hex_disk_expand(spark, sf):
    base = cells_d(spark, sf).select("cell").distinct()
    ring = C.hex_disk(base, "cell", 1, "n").selectExpr("n AS cell")
    return C.union_cells(base, ring)


def hex_corners(spark, sf):
    base = cells_d(spark, sf).select("cell").distinct()
    return base.selectExpr("cell", f"{hex_center('cell')} AS m", f"posexplode({hex_boundary('cell')}) AS (i, c)").selectExpr(
        "cell", "i", f"{round_to('m.x', 4)} AS cx", f"{round_to('m.y', 4)} AS cy",
        f"{round_to('c.x', 4)} AS x", f"{round_to('c.y', 4)} AS y",
    )


def polygon_area(spark, sf):
    return P.polygon_area(stand_edges(spark, sf), "stand_id")


def polygon_centroid(spark, sf):
    centroid = P.polygon_centroid(stand_edges(spark, sf), "stand_id")
    return centroid.selectExpr("stand_id", f"{round_to('x', 5)} AS x", f"{round_to('y', 5)} AS y")


def multipart_area(spark, sf):
    """Collections of a stand, a shifted copy and a line: polygon members only, one row per part."""
    collection = D.stands(spark, sf).selectExpr(
        "stand_id",
        "inline(array(struct('MULTIPOLYGON' AS geom_type, array(rings, transform(rings, r -> "
        "transform(r, p -> named_struct('x', p.x + 1000, 'y', p.y)))) AS parts), "
        "struct('LINESTRING' AS geom_type, array(rings) AS parts)))",
    )
    parts = P.explode_parts(P.polygon_members(collection), "stand_id")
    keyed = parts.selectExpr("concat(stand_id, '-', part) AS part_id", "rings")
    return P.polygon_area(P.edges(keyed, "part_id"), "part_id")


def binary_geometry(spark, sf):
    """Stands with a hole and points, written as binary and read back."""
    # Dealt anew: a small file of stands would be written as binary by one task.
    shapes = D.stands(spark, sf).repartition("stand_id").selectExpr(
        "stand_id", "concat(rings, array(transform(array(struct(4 AS a, 4 AS b), struct(2 AS a, 4 AS b), struct(4 AS a, 2 AS b)), c -> struct(ax + s / c.a AS x, ay + s / c.b AS y)))) AS rings"
    ).selectExpr("concat('s', stand_id) AS id", f"{polygon_binary('rings')} AS geometry")
    points = D.points_u(spark, sf).selectExpr("concat('p', tree_id) AS id", f"{point_binary('x', 'y')} AS geometry")
    read = read_geometry(shapes.unionByName(points))
    parts = P.explode_parts(read, "id")
    area = P.polygon_area(P.edges(parts, "id"), "id")
    places = parts.filter("geom_type = 'POINT'").selectExpr("id", "rings[0][0].x + rings[0][0].y AS v")
    return area.selectExpr("id", f"{round_to('area_m2', 6)} AS v").unionByName(places)


def dissolve_regions(spark, sf):
    grouped = P.edges(D.areas(spark, sf), "area_id", keep=("group_id",))
    return R.dissolve(grouped, "group_id")


def _plot_edges(spark, sf, width=100):
    return P.edges(D.plots(spark, sf, width), "plot_id", keep=("group_id",))


def _outline_facts(outline, key):
    """Length, area and what is left of faults in dissolved outlines."""
    area = P.polygon_area(P.with_origin(outline, key), key)
    return (
        P.outline_length(outline, key).join(area, key).join(R.coverage_check(outline, key, 500.0), key)
        .selectExpr(key, f"{round_to('length_m', 3)} AS length_m", f"{round_to('area_m2', 3)} AS area_m2", "open_vertices", "t_junctions", "crossings")
    )


def dissolve_tjunction(spark, sf):
    """Union of neighbours whose vertices don't match, slanted and with holes."""
    return _outline_facts(settle(R.dissolve(_plot_edges(spark, sf), "group_id", 500.0), "outline"), "group_id")


def dissolve_overlap(spark, sf):
    """Union of plots that overlap the next one by a quarter."""
    return _outline_facts(settle(R.dissolve(_plot_edges(spark, sf, 125), "group_id", 500.0), "outline"), "group_id").drop("length_m")


def coverage_faults(spark, sf):
    """T-junctions of the plots as they come, and the area that overlapping ones cover twice."""
    plots, wide = _plot_edges(spark, sf), _plot_edges(spark, sf, 125)
    union = settle(R.dissolve(wide, "group_id", 500.0), "outline")
    single = P.polygon_area(P.with_origin(union, "group_id"), "group_id")
    return (
        R.coverage_check(plots, "group_id", 500.0).join(P.polygon_area(wide, "group_id").withColumnRenamed("area_m2", "whole"), "group_id")
        .join(single, "group_id").selectExpr("group_id", "open_vertices", "t_junctions", "crossings", f"{round_to('whole - area_m2', 2)} AS overlap_m2")
    )


def outline_rings(spark, sf):
    """Rings of the dissolved plots: shells and holes with length and signed area."""
    rings = R.trace(R.dissolve(_plot_edges(spark, sf), "group_id", 500.0), "group_id")
    return R.ring_facts(rings, "group_id").groupBy(
        "group_id", F.expr(f"{round_to('length_m', 3)} AS length_m"), F.expr(f"{round_to('area_m2', 3, signed=True)} AS area_m2")
    ).agg(F.expr("count(1) AS rings"))


def outline_shapes(spark, sf):
    """The same as text, read back: rings, shells and the area within."""
    shapes = R.outline_shapes(R.dissolve(_plot_edges(spark, sf), "group_id", 500.0), "group_id", 500.0)
    points = "transform(split(r, ', '), p -> struct(double(split(p, ' ')[0]) - 380000 AS x, double(split(p, ' ')[1]) - 5810000 AS y))"
    ring_area = "aggregate(sequence(1, size(q) - 1), 0D, (acc, i) -> acc + (q[i - 1].x * q[i].y - q[i].x * q[i - 1].y) / 2)"
    return shapes.selectExpr(
        "group_id", "rings", "size(split(geometry, '[(][(]')) - 1 AS shells",
        "filter(split(substring(geometry, 14), '[()]+'), r -> r RLIKE '[0-9]') AS texts",
    ).selectExpr(
        # The shells are counted above, once a text; beside the explode they would be counted for each ring.
        "group_id", "rings", "shells", "explode(texts) AS r"
    ).repartition("r").selectExpr("group_id", "rings", "shells", f"{points} AS q").groupBy("group_id", "rings", "shells").agg(
        F.expr(f"{round_to(f'sum({ring_area})', 2)} AS area_m2")
    )


def outline_check(spark, sf):
    outline = districts(spark, sf)
    return (
        P.outline_length(outline, "bezirk_code")
        .join(R.coverage_check(outline, "bezirk_code"), "bezirk_code")
        .join(S.district_names(outline), "bezirk_code")
    )


def points_in_areas(spark, sf):
    inside = O.points_in_polygons(
        M.normalized_points(D.points_d(spark, sf)), area_edges(spark, sf), "area_id", SIDE
    )
    return inside.groupBy("area_id", "source").agg(F.count(F.lit(1)).alias("tree_count"))


def points_in_stands(spark, sf):
    """Concave, overlapping polygons: a point may lie in several."""
    inside = O.points_in_polygons(
        M.normalized_points(D.points_d(spark, sf)), stand_edges(spark, sf), "stand_id", 50.0, counted=True
    )
    return inside.groupBy("stand_id").agg(F.sum("n").alias("tree_count"))


def overlap_area(spark, sf):
    pairs = O.polygon_overlap_area(
        stand_edges(spark, sf), "stand_id", area_edges(spark, sf), "area_id", SIDE
    )
    return pairs.selectExpr("stand_id", "area_id", f"{round_to('area_m2', 4)} AS area_m2")


def clip_to_boundary(spark, sf):
    clipped = W.clipped_stands(D.stands(spark, sf), city(spark, sf), "city_id", SIDE)
    return clipped.selectExpr("stand_id", "p_brand", f"{round_to('area_ha', 6)} AS area_ha")


def clipped_shapes(spark, sf):
    """Geometry of the clipped stands; the trapezoids are disjoint, so their areas add up."""
    slabs = O.clip_to_boundary(stand_edges(spark, sf), "stand_id", city(spark, sf), "city_id", SIDE)
    traps = O.trapezoid_rings(O.slab_trapezoids(slabs, "stand_id"), "stand_id", SIDE)
    area = (
        "aggregate(sequence(0, 3), 0D, (acc, i) -> acc + (ring[i].x - ring[(i + 1) % 4].x) * "
        "(ring[i].y + ring[(i + 1) % 4].y - 2 * ring[0].y) / 2)"
    )
    return (
        traps.selectExpr("stand_id", f"{area} AS a")
        .groupBy("stand_id")
        .agg(F.expr(f"{round_to('sum(a)', 3)} AS area_m2"))
    )


def clip_rings(spark, sf):
    """Rings of each stand cut to each cell it covers, measured again as polygons."""
    cover = C.hex_cover(stand_edges(spark, sf), "stand_id", RES, "center+1")
    pairs = cover.join(D.stands(spark, sf).select("stand_id", "rings"), "stand_id")
    clipped = O.clip_rings_to_cell(pairs, "stand_id")
    keyed = clipped.selectExpr("struct(stand_id, cell) AS pair", "rings")
    area = P.polygon_area(P.edges(keyed, "pair"), "pair").filter("area_m2 > 1e-6")
    return area.selectExpr("pair.stand_id", "pair.cell", f"{round_to('area_m2', 3)} AS area_m2")


def unpivot_slots(spark, sf):
    return H.unpivot_slots(D.stands(spark, sf), ["stand_id"], M.SLOTS)


def weighted_histogram_top5(spark, sf):
    named = M.stand_genera(D.stands(spark, sf), D.lookup(spark, sf))
    grouped = named.selectExpr("stand_id % 25 AS area_id", "genus", "mix * 100 AS weight")
    return H.weighted_histogram(grouped, ["area_id"], "genus", "weight")


def hex_cover_center(spark, sf):
    return C.hex_cover(stand_edges(spark, sf), "stand_id", 10, "center")


def hex_cover_ring(spark, sf):
    cover = C.hex_cover(stand_edges(spark, sf), "stand_id", RES, "center+1")
    return cover.select("cell").distinct()


def hex_cover_touch(spark, sf):
    return C.hex_cover(stand_edges(spark, sf), "stand_id", RES, "touch")


def morph_close(spark, sf):
    cells = C.hex_cover(stand_edges(spark, sf), "stand_id", 11, "center").select("cell").distinct()
    return C.morph_close(cells, 1)


def forest_outline(spark, sf):
    closed, outline = W.forest_outline(
        D.stands(spark, sf), city(spark, sf), "city_id", res=11, k=1
    )
    length = P.outline_length(outline, "layer")
    counted = closed.agg(F.expr("count(1) AS cells")).withColumn("layer", F.lit("forests_union"))
    return length.join(counted, "layer").selectExpr(
        "layer", "cells", "edge_count", f"{round_to('length_m', 2)} AS length_m"
    )


def _area_mart(spark, sf, level, cube=None):
    points, stands, lookup = D.points_d(spark, sf), D.stands(spark, sf), D.lookup(spark, sf)
    if level == "ortsteile":
        names = D.areas(spark, sf).select("area_id", "area_name")
        counts = None if cube is None else M.area_counts(cube, "area_id")
        return M.area_mart(points, stands, lookup, area_edges(spark, sf), names, sources=SOURCES, counts=counts)
    outline = settle(districts(spark, sf), "districts")
    names = S.district_names(outline).withColumnRenamed("bezirk_name", "area_name")
    parents = D.areas(spark, sf).selectExpr("area_id", "substring(sch, 7, 2) AS bezirk_code")
    counts = None if cube is None else M.area_counts(cube, "area_id", parents)
    return M.area_mart(
        points, stands, lookup, outline, names, area_key="bezirk_code", sources=SOURCES, counts=counts
    )


def area_mart(spark, sf):
    return _area_mart(spark, sf, "ortsteile")


def district_mart(spark, sf):
    return _area_mart(spark, sf, "bezirke")


def _hex_mart(spark, sf, resolutions, **options):
    return M.hex_mart(
        D.points_d(spark, sf),
        D.stands(spark, sf),
        D.lookup(spark, sf),
        settle(city(spark, sf), "city"),
        resolutions=resolutions,
        sources=SOURCES,
        **options,
    )


def hex_mart(spark, sf):
    return _hex_mart(spark, sf, M.RESOLUTIONS).drop("geometry")


def hex_mart_touch(spark, sf):
    return _hex_mart(spark, sf, [RES], cover="touch").drop("geometry")


def hex_geometry(spark, sf):
    """Cell outlines in longitude and latitude, as exported."""
    base = cells_d(spark, sf).select("cell").distinct()
    ring = f"transform({hex_boundary('cell')}, c -> {utm33_to_lonlat('c.x', 'c.y')})"
    return base.selectExpr("cell", f"posexplode({ring}) AS (i, p)").selectExpr(
        "cell", "i", f"{round_to('p.lon', 6)} AS lon", f"{round_to('p.lat', 6)} AS lat"
    )


def city_summary(spark, sf):
    """The city row on top of all marts; their point counts come from one cube."""
    cube = M.count_cube(D.points_d(spark, sf), M.RESOLUTIONS, area_edges(spark, sf), "area_id")
    hexes = _hex_mart(spark, sf, M.RESOLUTIONS, counts=M.cell_counts(cube)).selectExpr(
        "concat('res', res) AS level", "tree_density_km2", "forest_cover_pct"
    )
    district = settle(_area_mart(spark, sf, "bezirke", cube), "bezirke")
    hood = _area_mart(spark, sf, "ortsteile", cube)
    admin = M.mart_levels({"bezirke": district, "ortsteile": hood})
    levels = settle(hexes.unionByName(admin), "levels")
    return M.city_summary(
        D.points_d(spark, sf), D.stands(spark, sf), D.lookup(spark, sf), city(spark, sf), district, levels, LEVELS,
        counts=M.city_counts(cube),
    )


def nest_summary(spark, sf):
    nested = M.nest_summary(city_summary(spark, sf), LEVELS)
    return nested.selectExpr(
        "tree_count",
        "size(top_genera) AS genera",
        "top_genera[0].genus AS first_genus",
        "aggregate(top_genera, 0L, (acc, g) -> acc + g.count) + top_genera_other_count AS named_trees",
        "size(forest_genera) AS forest_genera",
        "density_ranges.res9.p50 AS res9_p50",
        "density_ranges.res9.quantiles[10] AS res9_max",
    )


def _simple_levels(spark, sf):
    """Point density per cell at two resolutions, with a cover derived from the cell."""
    frames = []
    for res in (8, 9):
        counts = cells_d(spark, sf, res).groupBy("cell").agg(F.expr("count(1) AS n"))
        frames.append(
            counts.selectExpr(
                f"'res{res}' AS level",
                "cell",
                f"{round_to('n / 0.07D', 1)} AS tree_density_km2",
                "double(n % 101) AS forest_cover_pct",
            )
        )
    return reduce(DataFrame.unionByName, frames)


def density_quantiles(spark, sf):
    ranges = U.density_quantiles(_simple_levels(spark, sf))
    return ranges.selectExpr("level", "p50", "p95", "posexplode(quantiles) AS (i, q)").selectExpr(
        "level", "p50", "p95", "i", f"{round_to('q', 6)} AS q"
    )


def price_quantiles(spark, sf):
    """Exact quantiles over a whole table with one hot key."""
    items = D.table(spark, sf, "lineitem").selectExpr(
        "if(l_linestatus = 'O', 'hot', l_returnflag) AS grp", "l_extendedprice AS v"
    )
    ranks = U.rank_values(items, "grp", "v", [0.0, 0.25, 0.5, 0.9, 1.0])
    return ranks.selectExpr("grp", "fraction", f"{round_to('cont', 4)} AS cont", "disc")


def narrow_quantiles(spark, sf):
    """Many distinct values in a range too narrow for any common scale."""
    items = D.table(spark, sf, "lineitem").selectExpr(
        "l_linestatus AS grp", "1000000 + (l_orderkey * 7919 + l_linenumber * 104729) % 5000000 / 1000D AS v"
    )
    ranks = U.rank_values(items, "grp", "v", [0.0, 0.1, 0.5, 0.95, 1.0], bound=1000)
    return ranks.selectExpr("grp", "fraction", f"{round_to('cont', 4)} AS cont", "disc")


def density_rank(spark, sf):
    levels = settle(_simple_levels(spark, sf), "levels")
    ranked = M.ranked_mart(levels, U.density_quantiles(levels))
    return ranked.selectExpr(
        "level", "cell", "shown_density", f"{round_to('rank', 6)} AS rank"
    )


def linear_rank(spark, sf):
    """Straight ramp while a level has no quantiles."""
    levels = _simple_levels(spark, sf)
    none = levels.select("level").distinct().selectExpr(
        "level", "cast(NULL as array<double>) AS quantiles", "500 AS p95"
    )
    ranked = M.ranked_mart(levels, none)
    return ranked.selectExpr("level", "cell", f"{round_to('rank', 6)} AS rank")


def cover_bands(spark, sf):
    levels = _simple_levels(spark, sf)
    return levels.groupBy("level", F.expr(f"{cover_band('forest_cover_pct')} AS band")).agg(
        F.expr("count(1) AS cells")
    )


def histogram_rollup(spark, sf):
    return H.histogram_rollup(hex_histogram_top10(spark, sf), ["cell"], 4)


def histogram_rollup_9(spark, sf):
    """All but the last stored rank shown."""
    return H.histogram_rollup(hex_histogram_top10(spark, sf), ["cell"], 9)


def source_drift(spark, sf):
    """Documents as landed, against a baseline that derives one of each case from the same table."""
    docs = D.table(spark, sf, "documents")
    number = "try_cast(substring(source, 4, 9) as int) % 4"
    known = docs.groupBy("source").agg(
        F.expr(
            f"CASE WHEN {number} = 0 THEN count(1) WHEN {number} = 1 THEN count_if(n_chars > 400) "
            f"WHEN {number} = 2 THEN count(1) * 100 ELSE 0L END AS count"
        )
    )
    gone = docs.groupBy(F.expr("concat('gone-', lang) AS source")).agg(F.expr("count(1) AS count"))
    return Q.source_drift(Q.source_counts(docs), known.unionByName(gone), excluded=("src0",))


def advance_baseline(spark, sf):
    drift = source_drift(spark, sf)
    baseline = drift.selectExpr("source", "old_count AS count", "timestamp'2024-01-01' AS last_checked")
    ok = drift.filter("status IN ('ok', 'changed', 'kept')")
    stamp = F.expr("timestamp'2024-02-01'")
    moved = Q.advance_baseline(ok, baseline, stamp).selectExpr("'clean' AS run", "*")
    held = Q.advance_baseline(drift, baseline, stamp).selectExpr("'failed' AS run", "*")
    return moved.unionByName(held).selectExpr(
        "run", "source", "count", "date_format(last_checked, 'yyyy-MM-dd') AS last_checked"
    )


def profile_table(spark, sf):
    points = S.unify_sources(
        {s: S.stage_points(df, s) for s, df in D.raw_inventories(spark, sf).items()}
    )
    return Q.profile_table(points, [c for c in points.columns])


def geometry_types(spark, sf):
    """Rows per type of a mixed collection."""
    mixed = D.stands(spark, sf).selectExpr("if(p_size % 3 = 0, 'MultiPolygon', 'Polygon') AS geom_type")
    return Q.value_counts(mixed, "geom_type")


def expectations(spark, sf):
    points = S.unify_sources({s: S.stage_points(df, s) for s, df in D.raw_inventories(spark, sf).items()})
    return Q.expect_all(
        points,
        not_null=["tree_id", "source", "tree_uuid", "genus_latin", "planting_year"],
        unique=["tree_uuid", "species_latin"],
        in_set=[("source", POINT_SOURCES), ("source", POINT_SOURCES[:1])],
        min_rows=900_000,
    )


def missing_from_index(spark, sf):
    return Q.missing_from_index(
        D.table(spark, sf, "documents"), D.table(spark, sf, "labels"), "doc_id"
    )


def label_districts(spark, sf):
    staged = S.stage_neighbourhoods(D.areas(spark, sf).withColumnRenamed("area_name", "nam"))
    return staged.drop("rings").join(S.district_names(staged), "bezirk_code")


def _points_lonlat(spark, sf):
    return D.points_u(spark, sf).selectExpr(
        "*", f"{utm33_to_lonlat('x', 'y')} AS p"
    ).selectExpr("tree_id", "source", "genus_latin", "x", "y", "p.lon AS lon", "p.lat AS lat")


def reproject_points(spark, sf):
    return _points_lonlat(spark, sf).selectExpr(
        "tree_id", f"{round_to('lon', 7)} AS lon", f"{round_to('lat', 7)} AS lat"
    )


def reproject_back(spark, sf):
    """Degrees to metres by row: every other point arrives in degrees, all leave in metres."""
    mixed = _points_lonlat(spark, sf).selectExpr(
        "tree_id",
        "if(cast(tree_id as bigint) % 2 = 0, lon, x) AS x",
        "if(cast(tree_id as bigint) % 2 = 0, lat, y) AS y",
        "if(cast(tree_id as bigint) % 2 = 0, 'EPSG:4326', NULL) AS crs",
    )
    return reproject(mixed).selectExpr(
        "tree_id", f"{round_to('x', 3)} AS x", f"{round_to('y', 3)} AS y", "crs"
    )


def tile_assign(spark, sf):
    tiles = T.tile_assign(_points_lonlat(spark, sf), 6, 17)
    return tiles.groupBy("z", "tx", "ty").agg(F.expr("count(1) AS features"))


def tile_assign_boxes(spark, sf):
    corner = {n: utm33_to_lonlat(x, y) for n, x, y in (("a", "x0", "y0"), ("b", "x0 + 800D", "y0 + 800D"))}
    boxes = D.areas(spark, sf).selectExpr("area_id", f"{corner['a']} AS a", f"{corner['b']} AS b")
    boxes = boxes.selectExpr("area_id", "a.lon AS west", "a.lat AS south", "b.lon AS east", "b.lat AS north")
    return T.tile_assign_boxes(boxes, 4, 17).select("area_id", "z", "tx", "ty")


def tile_thin(spark, sf):
    tiles = T.tile_assign(_points_lonlat(spark, sf), 6, 17)
    return T.tile_thin(tiles, 200, "cast(tree_id as bigint)").select("z", "tx", "ty", "tree_id")


def _thinned(spark, sf, cap):
    points = _points_lonlat(spark, sf).withColumn("tree_id", F.expr("cast(tree_id as bigint)"))
    return T.tile_thin_densest(points, "tree_id", 6, 17, cap)


def tile_thin_densest(spark, sf):
    """Densest features leave crowded tiles first; survivors move up zoom by zoom."""
    return _thinned(spark, sf, 200)[0]


def tile_dropped(spark, sf):
    """How many features each tile keeps and loses at a cap that only coarse tiles reach."""
    return _thinned(spark, sf, 5000)[1]


def export_layers(spark, sf):
    """Layers written by archive and layer, then read back."""
    lonlat = _points_lonlat(spark, sf)
    trees = export_layer(
        lonlat.selectExpr("tree_id AS tree_uuid", "source", "genus_latin", f"{point_wkt('lon', 'lat')} AS geometry"),
        "trees",
        ["tree_uuid", "source"],
    )
    stands = export_layer(
        D.stands(spark, sf).selectExpr("stand_id", "p_brand", f"{polygon_wkt('rings')} AS geometry"), "forests"
    )
    centroids = export_layer(
        P.polygon_centroid(area_edges(spark, sf), "area_id").selectExpr(
            "area_id", f"{point_wkt('x', 'y')} AS geometry"
        ),
        "admin_ortsteile_centroids",
    )
    path = fresh_path(spark, "layers")
    write_layers([trees, stands, centroids], path, LAYER_ARCHIVES)
    return (
        spark.read.parquet(path)
        .groupBy("archive", "layer")
        .agg(
            F.expr("count(1) AS features"),
            F.expr("count(tree_uuid) AS points"),
            F.expr("count(DISTINCT geometry) AS shapes"),
        )
    )


def export_map(spark, sf):
    """Points, cells, cell centres, area centroids and the border, written and read back."""
    points = S.unify_sources(
        {s: S.stage_points(df, s) for s, df in D.raw_inventories(spark, sf).items()}
    )
    cells, centres = L.hex_layers(_hex_mart(spark, sf, [RES]), RES)
    hoods = L.area_centroids(
        D.areas(spark, sf).selectExpr("area_id", "area_name"), area_edges(spark, sf), "area_id", "admin_ortsteile_centroids"
    )
    path = fresh_path(spark, "map")
    write_layers([L.point_layer(points), cells, centres, hoods, L.border_layer(city(spark, sf))], path)
    return (
        spark.read.parquet(path)
        .groupBy("archive", "layer")
        .agg(
            F.expr("count(1) AS features"),
            F.expr("count(DISTINCT geometry) AS shapes"),
            F.expr("min(split_part(geometry, ' ', 1)) AS kind"),
            F.expr("sum(tree_count) AS tree_count"),
        )
    )


def export_all_layers(spark, sf):
    """All seventeen layers with geometry in degrees, written by archive and read back."""
    border = settle(city(spark, sf), "city")
    mart = settle(_hex_mart(spark, sf, M.RESOLUTIONS), "mart")
    outline = settle(districts(spark, sf), "districts")
    hood, district = (settle(_area_mart(spark, sf, level), level) for level in ("ortsteile", "bezirke"))
    levels = mart.selectExpr("concat('res', res) AS level", "tree_density_km2", "forest_cover_pct").unionByName(
        M.mart_levels({"bezirke": district, "ortsteile": hood})
    )
    summary = M.city_summary(
        D.points_d(spark, sf), D.stands(spark, sf), D.lookup(spark, sf), border, district, settle(levels, "levels"), LEVELS
    )
    points = S.unify_sources({s: S.stage_points(df, s) for s, df in D.raw_inventories(spark, sf).items()})
    _, forest = W.forest_outline(D.stands(spark, sf), border, "city_id", res=11, k=1)
    layers = [
        L.point_layer(points),
        *(layer for res in M.RESOLUTIONS for layer in L.hex_layers(mart, res)),
        *L.area_layers(hood, area_edges(spark, sf), "area_id", "admin_ortsteile"),
        *L.area_layers(district, outline, "bezirk_code", "admin_bezirke"),
        *L.city_layers(summary, border),
        *L.forest_layers(D.stands(spark, sf), border, "city_id", forest, SIDE),
    ]
    path = fresh_path(spark, "layers")
    write_layers(layers, path)
    # Every coordinate of every geometry is read back; all must lie in the city.
    numbers = "transform(filter(split(geometry, '[^0-9.E-]+'), t -> t RLIKE '[0-9]'), t -> double(t))"
    return (
        spark.read.parquet(path)
        .selectExpr("archive", "layer", "split_part(geometry, ' ', 1) AS kind", "tree_count", f"{numbers} AS n")
        .groupBy("archive", "layer", "kind")
        .agg(
            F.expr("count(1) AS features"), F.expr("sum(tree_count) AS tree_count"),
            F.expr("sum(size(filter(n, (v, i) -> if(i % 2 = 0, v < 13 OR v > 14, v < 52 OR v > 53)))) AS astray"),
        )
    )


def tile_shapes(spark, sf):
    """Stands on map tiles: the shares of all tiles of a zoom add up to the stand."""
    tiles = T.tile_shapes(stand_edges(spark, sf), "stand_id", 12, 17)
    return tiles.groupBy("stand_id", "z").agg(F.expr(f"{round_to('sum(share)', 6)} AS tiles"), F.expr("max(share) <= 1 + 1e-9D AS within"))


def lookup_join(spark, sf):
    """The code lookup written as CSV and read back with forced text columns."""
    path = fresh_path(spark, "lookup")
    D.lookup(spark, sf).selectExpr(
        "ba_code", "concat('name ', ba_code) AS deuts", "genus_latin", "'' AS notes"
    ).write.csv(path, header=True)
    return load_lookup(spark, path).select("ba_code", "deuts", "genus_latin")


def _write_pages(spark, sf, path):
    """Events as feature pages of a thousand, one JSON document per file."""
    feature = (
        "struct('Feature' AS type, struct('Point' AS type, array(380000 + value, 5810000 + user_id) "
        "AS coordinates) AS geometry, struct(event_id AS id, event_type AS art, props AS props) AS properties)"
    )
    pages = (
        D.table(spark, sf, "events")
        .selectExpr("floor(event_id / 1000) AS page", f"{feature} AS f")
        .groupBy("page")
        .agg(F.expr("to_json(struct('FeatureCollection' AS type, collect_list(f) AS features)) AS value"))
    )
    pages.select("value").write.text(path)


PROPERTIES = "id bigint, art string, props string"


def _page_report(rows):
    return rows.groupBy("art", "geom_type").agg(
        F.expr("count(1) AS features"),
        F.expr("count(DISTINCT id) AS ids"),
        F.expr(f"{round_to('sum(x - 380000)', 2)} AS sum_x"),
        F.expr("sum(y - 5810000) AS sum_y"),
        F.expr("sum(cast(get_json_object(props, '$.k') as bigint)) AS sum_k"),
    )


def ingest_pages(spark, sf):
    """Batch ingest of landed pages."""
    path = fresh_path(spark, "pages")
    _write_pages(spark, sf, path)
    return _page_report(ingest_feature_pages(spark, path, PROPERTIES, lines=True))


def ingest_pages_stream(spark, sf):
    """The same pages through the resumable file stream; the second run finds nothing new."""
    path, table, checkpoint = (fresh_path(spark, n) for n in ("pages", "landed", "progress"))
    _write_pages(spark, sf, path)
    for _ in range(2):
        land_pages(spark, path, table, checkpoint, PROPERTIES, lines=True).awaitTermination()
    return _page_report(spark.read.parquet(table))


def kept_counts(spark, sf):
    """Counts per cell kept up to date by a stream: one inventory a delivery, the last one delivered twice."""
    landed, counts, progress = (fresh_path(spark, n) for n in ("landed", "counts", "progress"))
    located = D.points_u(spark, sf).selectExpr("tree_id", f"{hex_cell('x', 'y', RES)} AS cell", "source")
    located = settle(located, "located")
    for delivery in ("F", "O", "P", "P"):
        located.filter(F.col("source") == delivery).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(located.schema).parquet(landed)
        keep_counts(stream, "tree_id", ["cell", "source"], counts, progress).awaitTermination()
        if delivery == "O":
            fold_counts(spark, counts, ["cell", "source"])
    return counted(spark, counts, ["cell", "source"])


def stored_model(spark, sf):
    """A scanned table, kept as a written model and read back by name."""
    load_table(spark, f"{sf}/part.parquet", "scanned_part")
    model = spark.sql("SELECT p_partkey, p_brand, p_size FROM scanned_part WHERE p_size > 10")
    materialize(model, "table", "large_part", fresh_path(spark, "large_part"))
    return spark.sql("SELECT p_brand, count(1) AS parts, sum(p_size) AS total_size FROM large_part GROUP BY p_brand")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        stage_unify,
        unified_points,
        normalize_category,
        label_districts,
        lookup_join,
        hex_count,
        hex_histogram_top10,
        city_histogram_top10,
        dominant_value,
        dominant_share,
        source_mix,
        share_of_total,
        proximity_dups,
        duplicate_ids,
        crowded_dups,
        hex_disk_expand,
        hex_corners,
        hex_geometry,
        polygon_area,
        polygon_centroid,
        multipart_area,
        binary_geometry,
        dissolve_regions,
        dissolve_tjunction,
        dissolve_overlap,
        coverage_faults,
        outline_rings,
        outline_shapes,
        outline_check,
        points_in_areas,
        points_in_stands,
        overlap_area,
        clip_to_boundary,
        clipped_shapes,
        clip_rings,
        unpivot_slots,
        weighted_histogram_top5,
        hex_cover_center,
        hex_cover_ring,
        hex_cover_touch,
        morph_close,
        forest_outline,
        area_mart,
        district_mart,
        hex_mart,
        hex_mart_touch,
        city_summary,
        nest_summary,
        density_quantiles,
        price_quantiles,
        narrow_quantiles,
        density_rank,
        linear_rank,
        cover_bands,
        histogram_rollup,
        histogram_rollup_9,
        source_drift,
        advance_baseline,
        profile_table,
        geometry_types,
        expectations,
        missing_from_index,
        reproject_points,
        reproject_back,
        tile_assign,
        tile_assign_boxes,
        tile_thin,
        tile_thin_densest,
        tile_dropped,
        export_layers,
        export_map,
        export_all_layers,
        tile_shapes,
        ingest_pages,
        ingest_pages_stream,
        kept_counts,
        stored_model,
    )
}
