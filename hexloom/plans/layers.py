"""Map layers ready for export: attributes plus geometry text in longitude and latitude."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.hexgrid import hex_center
from hexloom.functions.projection import degrees_text, utm33_to_lonlat
from hexloom.functions.wkt import point_wkt
from hexloom.operators.outlines import outline_shapes
from hexloom.operators.polygons import polygon_centroid, with_origin
from hexloom.plans.forests import clipped_stands, stand_shapes
from hexloom.sources.export import export_layer
from hexloom.sources.fixed_values import POINT_EXPORT_COLUMNS


def point_layer(points: DataFrame, layer: str = "trees") -> DataFrame:
    """Single points with the exported columns only."""
    placed = points.selectExpr(*POINT_EXPORT_COLUMNS, f"{utm33_to_lonlat('x', 'y')} AS p")
    shaped = placed.selectExpr(*POINT_EXPORT_COLUMNS, f"{point_wkt('p.lon', 'p.lat')} AS geometry")
    return export_layer(shaped, layer)


def hex_layers(mart: DataFrame, res: int) -> tuple[DataFrame, DataFrame]:
    """Cells of one resolution as outlines and as centre points, with all mart columns."""
    cells = mart.filter(f"res = {res}")
    names = [c for c in cells.columns if c not in ("geometry", "res")]
    centre = hex_center("cast(conv(h3_index, 16, 10) as bigint)")
    centres = (
        cells.selectExpr(*names, f"{centre} AS m")
        .selectExpr(*names, f"{utm33_to_lonlat('m.x', 'm.y')} AS p")
        .selectExpr(*names, f"{point_wkt('p.lon', 'p.lat')} AS geometry")
    )
    return (
        export_layer(cells.drop("res"), f"h3_res{res}"),
        export_layer(centres, f"h3_res{res}_centroids"),
    )


def area_centroids(mart: DataFrame, area_edges: DataFrame, key: str, layer: str) -> DataFrame:
    """Admin mart rows with the centroid of their area."""
    centroid = polygon_centroid(with_origin(area_edges, key), key).selectExpr(
        f"cast({key} as string) AS area_id", f"{utm33_to_lonlat('x', 'y')} AS p"
    )
    joined = mart.selectExpr("cast(area_id as string) AS area_id", *[c for c in mart.columns if c != "area_id"])
    placed = joined.join(centroid, "area_id").selectExpr("*", f"{point_wkt('p.lon', 'p.lat')} AS geometry")
    return export_layer(placed.drop("p"), layer)


def border_layer(outline: DataFrame, layer: str = "berlin_border") -> DataFrame:
    """Outline edges, one line each: no task ever holds the whole border."""
    ends = outline.selectExpr(
        f"{utm33_to_lonlat('x1', 'y1')} AS a", f"{utm33_to_lonlat('x2', 'y2')} AS b"
    )
    line = "concat('LINESTRING (', a.lon, ' ', a.lat, ', ', b.lon, ' ', b.lat, ')') AS geometry"
    return export_layer(ends.selectExpr(line), layer)


def shapes_in_degrees(outline: DataFrame, key: str, side: float = 250.0) -> DataFrame:
    """(key, geometry): outlines as MULTIPOLYGON text in longitude and latitude."""
    return outline_shapes(outline, key, side, degrees_text("x1", "y1")).drop("rings")


def area_layers(mart: DataFrame, outline: DataFrame, key: str, layer: str) -> tuple[DataFrame, DataFrame]:
    """Admin mart rows with the shape of their area, and with its centroid."""
    rows = mart.selectExpr("cast(area_id as string) AS area_id", *[c for c in mart.columns if c != "area_id"])
    shapes = shapes_in_degrees(outline, key).selectExpr(f"cast({key} as string) AS area_id", "geometry")
    return export_layer(rows.join(shapes, "area_id"), layer), area_centroids(mart, outline, key, f"{layer}_centroids")


def city_layers(summary: DataFrame, outline: DataFrame, key: str = "city_id") -> tuple[DataFrame, DataFrame]:
    """The border as one shape, and the city's row with it. Both hold one row, so joining them costs nothing."""
    border = shapes_in_degrees(outline, key).select("geometry")
    row = summary.withColumn("one", F.lit(1)).join(border.withColumn("one", F.lit(1)), "one").drop("one")
    return export_layer(border, "berlin_border"), export_layer(row, "agg_berlin")


def forest_layers(
    stands: DataFrame, boundary: DataFrame, boundary_key: str, forest_outline: DataFrame, side: float, stand_key: str = "stand_id"
) -> tuple[DataFrame, DataFrame]:
    """Stands inside the boundary with attributes, area and clipped shape; and the generalised forest."""
    shaped = clipped_stands(stands, boundary, boundary_key, side, stand_key).join(
        stand_shapes(stands, boundary, boundary_key, side, stand_key), stand_key
    )
    return export_layer(shaped, "forests"), export_layer(shapes_in_degrees(forest_outline, "layer").select("geometry"), "forests_union")
