"""Forest layers: stands cut to the city and the generalised outline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.numeric import round_to
from hexloom.functions.projection import utm33_to_lonlat
from hexloom.functions.wkt import multipolygon_wkt
from hexloom.operators.cells import hex_cover, hex_edges, morph_close
from hexloom.operators.outlines import cancel_shared
from hexloom.operators.overlay import clip_to_boundary, slab_trapezoids, trapezoid_rings
from hexloom.operators.polygons import MIN_OVERLAP_M2, edges, slab_area


def clipped_stands(
    stands: DataFrame, boundary: DataFrame, boundary_key: str, side: float, stand_key: str = "stand_id"
) -> DataFrame:
    """Stands inside the boundary with their remaining area in hectares."""
    slabs = clip_to_boundary(edges(stands, stand_key), stand_key, boundary, boundary_key, side)
    area = slab_area(slabs, stand_key).filter(F.col("area_m2") > MIN_OVERLAP_M2)
    return stands.drop("rings").join(
        area.select(stand_key, (F.col("area_m2") / 10000.0).alias("area_ha")), stand_key
    )


def stand_shapes(
    stands: DataFrame, boundary: DataFrame, boundary_key: str, side: float, stand_key: str = "stand_id"
) -> DataFrame:
    """(stand, geometry): the clipped shape of each stand in degrees, as MULTIPOLYGON text of trapezoids."""
    slabs = clip_to_boundary(edges(stands, stand_key), stand_key, boundary, boundary_key, side)
    traps = trapezoid_rings(slab_trapezoids(slabs, stand_key), stand_key, side)
    degrees = f"transform(ring, c -> {utm33_to_lonlat('c.x', 'c.y')})"
    rounded = ", ".join(f"'{a}', {round_to(f'd.{b}', 7, signed=True)}" for a, b in (("x", "lon"), ("y", "lat")))
    traps = traps.selectExpr(stand_key, f"transform({degrees}, d -> named_struct({rounded})) AS ring")
    # One list per stand: it is the geometry value of that one feature.
    parts = traps.groupBy(stand_key).agg(F.array_sort(F.collect_list(F.array("ring"))).alias("parts"))
    return parts.selectExpr(stand_key, f"{multipolygon_wkt('parts')} AS geometry")


def forest_outline(
    stands: DataFrame,
    boundary: DataFrame,
    boundary_key: str,
    res: int = 12,
    k: int = 3,
    stand_key: str = "stand_id",
) -> tuple[DataFrame, DataFrame]:
    """Generalised forest area: (cells, outline edges).

    Stands become fine cells, gaps up to ``2k`` cells close, and cells whose centre lies outside the
    boundary are cut off. Accurate to one cell width against round buffers of the same size.
    """
    cells = hex_cover(edges(stands, stand_key), stand_key, res, "center").select("cell").distinct()
    inside = hex_cover(boundary, boundary_key, res, "center").select("cell").distinct()
    closed = morph_close(cells, k).join(inside, "cell", "left_semi")
    outline = cancel_shared(hex_edges(closed).withColumn("layer", F.lit("forests_union")), "layer")
    return closed, outline
