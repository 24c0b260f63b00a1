"""Marts: hex cells, administrative areas and the city summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.hexgrid import cell_res, cell_string, hex_boundary, hex_cell_any, hex_grids
from hexloom.functions.measures import (
    area_metrics,
    ascending_stops,
    clamp_top,
    density_rank,
    suppress_artefacts,
)
from hexloom.functions.numeric import percent, ratio, round_to
from hexloom.functions.text import normalize_genus, normalize_species
from hexloom.functions.wkt import polygon_wkt
from hexloom.functions.projection import utm33_to_lonlat
from hexloom.operators.cells import hex_cover, hex_disk, hex_edges, union_cells
from hexloom.operators.histogram import (
    point_profile,
    unpivot_slots,
    weighted_histogram,
)
from hexloom.operators.overlay import (
    clip_slabs,
    clip_to_boundary,
    points_in_polygons,
    slab_overlap_area,
)
from hexloom.operators.polygons import cut_to_grid, edges, polygon_area, slab_area, with_origin
from hexloom.operators.quantiles import density_quantiles
from hexloom.session import settle
from hexloom.sources.fixed_values import POINT_SOURCES

RESOLUTIONS = (6, 7, 8, 9)
SIDE = 250.0
SLOTS = tuple((f"ba{i}", f"m{i}") for i in range(1, 6))
HISTOGRAM = [
    *[c for i in range(1, 11) for c in (f"tree_genus_{i}", f"tree_genus_{i}_count", f"tree_genus_{i}_share")],
    "tree_genus_other_count",
    "tree_genus_other_share",
]
MIXTURE = [
    *[c for i in range(1, 6) for c in (f"forest_genus_{i}", f"forest_genus_{i}_share")],
    "forest_genus_other_share",
]
METRICS = ["berlin_area_km2", "forest_area_km2", "non_forest_area_km2", "forest_cover_pct"]


def normalized_points(points: DataFrame) -> DataFrame:
    """Only what marts need: place, source, normalised genus and species."""
    return points.filter("x IS NOT NULL AND y IS NOT NULL").selectExpr(
        "x",
        "y",
        "source",
        f"{normalize_genus('genus_latin', 'species_latin')} AS genus",
        f"{normalize_species('species_latin')} AS species",
    )


def located_points(points: DataFrame, resolutions: Sequence[int]) -> DataFrame:
    """Normalised points once per resolution with their cell."""
    return (
        normalized_points(points)
        .selectExpr("*", f"inline({hex_grids(resolutions)})")
        .selectExpr(f"{hex_cell_any('x', 'y')} AS cell", "genus", "species", "source")
    )


def count_cube(
    points: DataFrame, resolutions: Sequence[int], area_edges: DataFrame, area_key: str, side: float = SIDE
) -> DataFrame:
    """Points read once for all marts: (cell, area_key, source, genus, species, n), settled.

    One row per cell of every resolution, without an area, and one per area, without a cell; points
    outside all areas have neither. Coarser areas and the city are sums of the latter, see
    ``area_counts``. A point yields one row per resolution and one more ahead of the map-side combine.
    """
    placed = points_in_polygons(normalized_points(points), area_edges, area_key, side, keep_outside=True)
    no_cell = "array(named_struct('pitch', cast(NULL AS double), 'rows', cast(NULL AS double), 'origin', cast(NULL AS bigint)))"
    rows = placed.selectExpr("*", f"inline(concat({hex_grids(resolutions)}, {no_cell}))").selectExpr(
        f"if(pitch IS NULL, NULL, {hex_cell_any('x', 'y')}) AS cell",
        f"if(pitch IS NULL, {area_key}, NULL) AS {area_key}",
        "source",
        "genus",
        "species",
    )
    counts = rows.groupBy("cell", area_key, "source", "genus", "species").agg(F.expr("count(1) AS n"))
    return settle(counts, "cube")


def cell_counts(cube: DataFrame) -> DataFrame:
    """The part of a cube by cells, for ``hex_mart``."""
    return cube.filter("cell IS NOT NULL").select("cell", "source", "genus", "species", "n")


def area_counts(cube: DataFrame, area_key: str, groups: DataFrame | None = None) -> DataFrame:
    """The part of a cube by areas, for ``area_mart``; with ``groups`` (area_key, group key) by those."""
    areas = cube.filter(f"cell IS NULL AND {area_key} IS NOT NULL").drop("cell")
    return areas if groups is None else areas.join(groups, area_key).drop(area_key)


def city_counts(cube: DataFrame) -> DataFrame:
    """All points of a cube once, inside the areas or not, for ``city_summary``."""
    return cube.filter("cell IS NULL").select("source", "genus", "species", "n")


def stand_genera(stands: DataFrame, lookup: DataFrame, stand_key: str = "stand_id") -> DataFrame:
    """(stand, genus, mix): known codes of each stand with their summed share as a fraction."""
    slots = unpivot_slots(stands, [stand_key], SLOTS)
    named = lookup.filter("genus_latin != ''").selectExpr(
        "ba_code AS code", "lower(genus_latin) AS genus"
    )
    return (
        slots.join(named, "code")
        .groupBy(stand_key, "genus")
        .agg(F.expr("sum(share / 100D) AS mix"))
    )


def forest_stats(
    overlaps: DataFrame, keys: Sequence[str], genera: DataFrame, stand_key: str = "stand_id"
) -> tuple[DataFrame, DataFrame]:
    """Forest area and area-weighted genus mixture per region from (region, stand, area) rows."""
    totals = overlaps.groupBy(*keys).agg(F.sum("area_m2").alias("forest_area_m2"))
    weighted = overlaps.join(genera, stand_key).selectExpr(*keys, "genus", "area_m2 * mix AS weight")
    return totals, weighted_histogram(weighted, keys, "genus", "weight")


def forest_cells(
    stand_edges: DataFrame,
    stand_key: str,
    boundary: DataFrame,
    boundary_key: str,
    resolutions: Sequence[int],
    mode: str = "center+1",
) -> DataFrame:
    """Distinct cells of the stands inside the boundary, at all resolutions."""
    parts = []
    for res in resolutions:
        if mode == "touch":
            parts.append(hex_cover(stand_edges, stand_key, res, "touch"))
            continue
        inside = hex_cover(boundary, boundary_key, res, "center").select("cell").distinct()
        core = hex_cover(stand_edges, stand_key, res, "center").select("cell").distinct()
        core = core.join(inside, "cell", "left_semi")
        parts.append(hex_disk(core, "cell", 1, "n").selectExpr("n AS cell"))
    return union_cells(*parts)


def hex_mart(
    points: DataFrame,
    stands: DataFrame,
    lookup: DataFrame,
    boundary: DataFrame,
    boundary_key: str = "city_id",
    stand_key: str = "stand_id",
    resolutions: Sequence[int] = RESOLUTIONS,
    sources: Sequence[str] = POINT_SOURCES,
    side: float = SIDE,
    cover: str = "center+1",
    drop_duplicates: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per cell and resolution with point statistics, forest mixture and density.

    All resolutions share one pass: a point yields one cell id per resolution and the id carries the
    resolution. Points are read once and settle as one row per cell; every later join works on cells
    or slabs. Cells outside the boundary and cells with neither points nor forest drop out. With
    ``counts`` from a cube the points are not read.
    """
    if drop_duplicates:
        points = points.filter(~F.col("is_potential_duplicate"))
    if counts is None:
        profile = point_profile(located_points(points, resolutions), ["cell"], sources)
    else:
        profile = point_profile(counts, ["cell"], sources, weight="n")
    profile = settle(profile, "profile")

    stand_edges = edges(stands, stand_key)
    cells = union_cells(
        profile,
        forest_cells(stand_edges, stand_key, boundary, boundary_key, resolutions, cover),
    )
    boundary_slabs = cut_to_grid(boundary, boundary_key, side)
    hex_slabs = cut_to_grid(hex_edges(settle(cells, "cells")), "cell", side)
    inside = slab_overlap_area(hex_slabs, "cell", boundary_slabs, boundary_key, "area_m2")
    inside = inside.groupBy("cell").agg(F.sum("area_m2").alias("berlin_area_m2"))
    stand_slabs = clip_slabs(
        cut_to_grid(stand_edges, stand_key, side), stand_key, boundary_slabs, boundary_key
    )
    overlaps = settle(slab_overlap_area(hex_slabs, "cell", stand_slabs, stand_key), "overlaps")
    totals, mixture = forest_stats(overlaps, ["cell"], stand_genera(stands, lookup, stand_key), stand_key)

    joined = (
        inside.join(profile, "cell", "left")
        .join(totals, "cell", "left")
        .join(mixture, "cell", "left")
        .filter("coalesce(tree_count, 0) > 0 OR coalesce(forest_area_m2, 0D) > 0")
    )
    metrics = area_metrics("berlin_area_m2", "forest_area_m2", "tree_count")
    corner = utm33_to_lonlat("c.x", "c.y")
    ring = f"transform({hex_boundary('cell')}, c -> {corner})"
    rounded = (
        f"transform({ring}, d -> named_struct('x', {round_to('d.lon', 7, signed=True)}, "
        f"'y', {round_to('d.lat', 7, signed=True)}))"
    )
    return joined.selectExpr(
        f"{cell_string('cell')} AS h3_index",
        f"{cell_res('cell')} AS res",
        "coalesce(tree_count, 0) AS tree_count",
        "dominant_genus",
        "coalesce(genus_count, 0) AS genus_count",
        "dominant_species",
        "coalesce(species_count, 0) AS species_count",
        "dominant_species_pct",
        *[f"coalesce(source_{s}, 0) AS source_{s}" for s in sources],
        *HISTOGRAM,
        *[f"{metrics[m]} AS {m}" for m in METRICS],
        *MIXTURE,
        f"{metrics['tree_density_km2']} AS tree_density_km2",
        f"{polygon_wkt(f'array({rounded})')} AS geometry",
    )


def area_mart(
    points: DataFrame,
    stands: DataFrame,
    lookup: DataFrame,
    area_edges: DataFrame,
    names: DataFrame,
    area_key: str = "area_id",
    stand_key: str = "stand_id",
    sources: Sequence[str] = POINT_SOURCES,
    side: float = SIDE,
    boundary: DataFrame | None = None,
    boundary_key: str = "city_id",
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per administrative area that holds points; same columns as the hex mart.

    ``names`` has (area_key, area_name). ``boundary`` clips the stands first; areas of one coverage
    do not need it, since an area lies inside the city it is part of. With ``counts`` from a cube the
    points are not read.
    """
    if counts is None:
        inside = points_in_polygons(normalized_points(points), area_edges, area_key, side)
        profile = point_profile(inside, [area_key], sources)
    else:
        profile = point_profile(counts, [area_key], sources, weight="n")
    stand_edges = edges(stands, stand_key)
    stand_slabs = (
        cut_to_grid(stand_edges, stand_key, side)
        if boundary is None
        else clip_to_boundary(stand_edges, stand_key, boundary, boundary_key, side)
    )
    area_slabs = cut_to_grid(area_edges, area_key, side)
    overlaps = settle(slab_overlap_area(area_slabs, area_key, stand_slabs, stand_key), "overlaps")
    totals, mixture = forest_stats(overlaps, [area_key], stand_genera(stands, lookup, stand_key), stand_key)
    areas = polygon_area(with_origin(area_edges, area_key), area_key)
    joined = (
        areas.join(names, area_key)
        .join(profile, area_key)
        .join(totals, area_key, "left")
        .join(mixture, area_key, "left")
    )
    metrics = area_metrics("area_m2", "forest_area_m2", "tree_count")
    return joined.selectExpr(
        f"{area_key} AS area_id",
        "area_name",
        "tree_count",
        "dominant_genus",
        "genus_count",
        "dominant_species",
        "species_count",
        "dominant_species_pct",
        *[f"source_{s}" for s in sources],
        *HISTOGRAM,
        *[f"{metrics[m]} AS {m}" for m in METRICS],
        *MIXTURE,
        f"{metrics['tree_density_km2']} AS tree_density_km2",
    )


def mart_levels(marts: dict[str, DataFrame]) -> DataFrame:
    """(level, tree_density_km2, forest_cover_pct) rows of all marts."""
    rows = [
        df.select(F.lit(level).alias("level"), "tree_density_km2", "forest_cover_pct")
        for level, df in marts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def city_summary(
    points: DataFrame,
    stands: DataFrame,
    lookup: DataFrame,
    boundary: DataFrame,
    districts: DataFrame,
    levels: DataFrame,
    level_names: Sequence[str],
    boundary_key: str = "city_id",
    stand_key: str = "stand_id",
    side: float = SIDE,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row for the city: totals, histogram, mixture, area sums and density quantiles per level.

    ``districts`` is the district mart (its rounded areas are summed), ``levels`` the rows of
    ``mart_levels``. Counts include points outside the boundary. With ``counts`` from a cube the points
    are not read.
    """
    if counts is None:
        profile = point_profile(normalized_points(points), [], ())
    else:
        profile = point_profile(counts, [], (), weight="n")
    clipped = clip_to_boundary(edges(stands, stand_key), stand_key, boundary, boundary_key, side)
    overlaps = slab_area(clipped, stand_key).filter(F.col("area_m2") > 1e-6)
    _, mixture = forest_stats(overlaps, [], stand_genera(stands, lookup, stand_key), stand_key)
    area_sums = districts.agg(
        *[F.expr(f"{round_to(f'sum({m})', 2)} AS {m}") for m in METRICS if m != "forest_cover_pct"]
    )
    ranges = density_quantiles(levels).selectExpr("*", "to_json(quantiles) AS q")
    ranges = ranges.agg(
        *[
            F.expr(f"max(CASE WHEN level = '{level}' THEN {value} END) AS density_{level}_{name}")
            for level in level_names
            for name, value in (("p50", "p50"), ("p95", "p95"), ("quantiles", "q"))
        ]
    )
    # Each part is one row with columns of its own; stacking them needs no join.
    parts = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), (profile, area_sums, mixture, ranges)
    )
    row = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    return row.selectExpr(
        "tree_count",
        "genus_count",
        "berlin_area_km2",
        "forest_area_km2",
        "non_forest_area_km2",
        f"{percent('forest_area_km2', 'berlin_area_km2')} AS forest_cover_pct",
        f"{round_to(ratio('tree_count', 'non_forest_area_km2'), 1)} AS tree_density_km2",
        *HISTOGRAM,
        *MIXTURE,
        *[f"density_{level}_{n}" for level in level_names for n in ("p50", "p95", "quantiles")],
    )


def nest_summary(summary: DataFrame, level_names: Sequence[str]) -> DataFrame:
    """Wide city row to nested arrays: genera, forest genera and density ranges per level."""
    genera = ", ".join(
        f"struct(tree_genus_{i} AS genus, tree_genus_{i}_count AS count, tree_genus_{i}_share AS share)"
        for i in range(1, 11)
    )
    forest = ", ".join(
        f"struct(forest_genus_{i} AS genus, forest_genus_{i}_share AS share)" for i in range(1, 6)
    )
    ranges = ", ".join(
        f"struct(density_{level}_p50 AS p50, density_{level}_p95 AS p95, "
        f"from_json(density_{level}_quantiles, 'array<double>') AS quantiles) AS {level}"
        for level in level_names
    )
    named = "g -> g.genus IS NOT NULL AND g.genus != ''"
    return summary.selectExpr(
        "tree_count",
        "genus_count",
        *METRICS,
        "tree_density_km2",
        f"filter(array({genera}), {named}) AS top_genera",
        "tree_genus_other_count AS top_genera_other_count",
        "tree_genus_other_share AS top_genera_other_share",
        f"filter(array({forest}), {named}) AS forest_genera",
        "coalesce(forest_genus_other_share, 0D) AS forest_genus_other_share",
        f"struct({ranges}) AS density_ranges",
    )


def ranked_mart(mart: DataFrame, ranges: DataFrame, key: str = "level") -> DataFrame:
    """Mart rows with the artefact-free density and its rank on the level's deciles.

    ``ranges`` has one row per level, so its stops are prepared once and joined on the level.
    """
    stops = ranges.selectExpr(
        key, "p95", f"{ascending_stops(clamp_top('quantiles', 'p95'))} AS stops"
    )
    value = suppress_artefacts("tree_density_km2", "forest_cover_pct", "p95")
    return (
        mart.join(stops, key, "left")
        .selectExpr("*", f"{value} AS shown_density")
        .selectExpr("*", f"{density_rank('shown_density', 'stops', 'p95')} AS rank")
        .drop("stops")
    )
