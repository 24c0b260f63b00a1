"""Web-map tiles: which feature goes to which tile, and thinning of dense tiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.projection import mercator, tile_x, tile_y, utm33_to_lonlat
from hexloom.operators.histogram import top_k_per_group
from hexloom.operators.polygons import cut_to_grid
from hexloom.session import settle

TILE = ("z", "tx", "ty")


def tile_assign(features: DataFrame, zoom_min: int, zoom_max: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Point features once per zoom with their tile (z, tx, ty)."""
    return features.selectExpr("*", f"explode(sequence({zoom_min}, {zoom_max})) AS z").selectExpr(
        "*", f"{tile_x(lon, 'z')} AS tx", f"{tile_y(lat, 'z')} AS ty"
    )


def tile_assign_boxes(
    features: DataFrame, zoom_min: int, zoom_max: int, box: Sequence[str] = ("west", "south", "east", "north")
) -> DataFrame:
    """Extended features once per zoom and per tile their bounding box touches."""
    west, south, east, north = box
    return (
        features.selectExpr("*", f"explode(sequence({zoom_min}, {zoom_max})) AS z")
        .selectExpr("*", f"explode(sequence({tile_x(west, 'z')}, {tile_x(east, 'z')})) AS tx")
        .selectExpr("*", f"explode(sequence({tile_y(north, 'z')}, {tile_y(south, 'z')})) AS ty")
    )


def tile_shapes(edge_table: DataFrame, key: str, zoom_min: int, zoom_max: int) -> DataFrame:
    """(key, z, tx, ty, share): tiles that polygons really overlap, with the covered share of the tile.

    Edges come in metres. On the map a tile is a unit square, so cutting the scaled outline by the unit
    grid clips the shape to every tile: tiles the outline runs through come from its edges, tiles inside
    from the spans of each row. A shape of a whole continent spreads over its rows; no row of the table
    stands for a whole zoom. Boxes that only touch a tile's bounding box give none.
    """
    ends = {n: mercator("q.lon", "q.lat").replace("q.", f"{n}.") for n in ("a", "b")}
    scaled = (
        edge_table.selectExpr(key, f"{utm33_to_lonlat('x1', 'y1')} AS a", f"{utm33_to_lonlat('x2', 'y2')} AS b")
        .selectExpr(key, f"{ends['a']} AS a", f"{ends['b']} AS b")
        .selectExpr(key, "a", "b", f"explode(sequence({zoom_min}, {zoom_max})) AS z")
        .selectExpr(
            f"struct({key}, z) AS kz", "a.u * pow(2D, z) AS x1", "a.v * pow(2D, z) AS y1", "b.u * pow(2D, z) AS x2", "b.v * pow(2D, z) AS y2"
        )
    )
    slabs = cut_to_grid(scaled, "kz", 1.0)
    shares = slabs.groupBy("kz", "bx", "by").agg(F.expr("sum(s * (x2 - x1) * (y1 + y2) / 2) AS share")).filter("share > 1e-12")
    return shares.selectExpr(f"kz.{key}", "kz.z", "bx AS tx", "bigint(pow(2D, kz.z)) - 1 - by AS ty", "share")


def tile_thin(tiles: DataFrame, cap: int, order: str) -> DataFrame:
    """At most ``cap`` features per tile, first in a stable order.

    The rank filter is pushed below the shuffle, so a low-zoom tile that covers everything receives
    at most ``cap`` rows per map task.
    """
    return top_k_per_group(tiles, TILE, order, cap).drop("rn")


#: Zoom whose tiles are the places of the curve, and the zoom at which thinning starts.
PLACE_ZOOM, START_ZOOM = 26, 22


_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(columns: DataFrame, *names: str) -> DataFrame:
    """Bits of numbers below 2^26 moved to the even places, a shift and a mask at a time."""
    for shift, mask in _MASKS:
        columns = columns.withColumns({n: F.expr(f"({n} | shiftleft({n}, {shift})) & {mask}L") for n in names})
    return columns


def _number(tile: str, odd: int, zoom: int) -> str:
    """x (even places) or y (odd places) of a tile from its bits of the curve."""
    return f"aggregate(sequence(0, {zoom - 1}), 0L, (a, i) -> a | shiftleft(shiftright({tile}, 2 * i + {odd}) & 1L, i))"


def tile_thin_densest(
    features: DataFrame, id: str, zoom_min: int, zoom_max: int, cap: int, lon: str = "lon", lat: str = "lat"
) -> tuple[DataFrame, DataFrame]:
    """Thin tiles to ``cap`` features, densest first: ((z, tx, ty, id), (z, tx, ty, kept, dropped)).

    Features lie on a space-filling curve; in a tile with too many, those with the smallest gap to the
    one before them go first, ties by the larger id. Zooms run from fine to coarse and only survivors
    move up, so a tile hears from its four parts of ``cap`` features each, however many rows lie in it.
    It starts below the finest zoom: features of one place beyond ``cap`` leave there, trimmed in the
    tasks that read them, so a start tile holds a fixed number of places of ``cap`` features.
    """
    located = features.selectExpr(id, f"bigint({tile_x(lon, str(PLACE_ZOOM))}) AS px", f"bigint({tile_y(lat, str(PLACE_ZOOM))}) AS py")
    placed = _spread(located, "px", "py").selectExpr(id, "px | shiftleft(py, 1) AS m")
    placed = settle(placed, "placed")
    counts = settle(placed.groupBy(F.expr(f"shiftrightunsigned(m, {2 * (PLACE_ZOOM - zoom_max)}) AS t")).agg(F.expr("count(1) AS n")), "counts")
    alive = top_k_per_group(placed, ["m"], id, cap).drop("rn")
    kept: list[DataFrame] = []
    for z in range(max(START_ZOOM, zoom_max), zoom_min - 1, -1):
        gaps = alive.selectExpr(
            id, "m", f"shiftrightunsigned(m, {2 * (PLACE_ZOOM - z)}) AS t"
        ).selectExpr("*", f"coalesce(m - lag(m) OVER (PARTITION BY t ORDER BY m, {id}), {1 << 62}L) AS gap")
        alive = settle(
            gaps.selectExpr("*", f"row_number() OVER (PARTITION BY t ORDER BY gap DESC, {id}) AS rn").filter(f"rn <= {cap}").select(id, "m"), "alive"
        )
        if z <= zoom_max:
            kept.append(alive.selectExpr(f"{z} AS z", id, f"shiftrightunsigned(m, {2 * (PLACE_ZOOM - z)}) AS t"))
    survivors = reduce(DataFrame.unionByName, kept)
    totals = counts.selectExpr("t", "n", f"explode(sequence({zoom_min}, {zoom_max})) AS z").selectExpr(
        "z", f"shiftrightunsigned(t, 2 * ({zoom_max} - z)) AS t", "n"
    ).groupBy("z", "t").agg(F.sum("n").alias("n"))
    report = totals.join(survivors.groupBy("z", "t").agg(F.expr("count(1) AS kept")), ["z", "t"]).selectExpr("z", "t", "kept", "n - kept AS dropped")
    # A tile's number is its bits of the curve: x on the even places, y on the odd ones.
    place = [f"{_number('t', odd, zoom_max)} AS {name}" for odd, name in ((0, "tx"), (1, "ty"))]
    return survivors.selectExpr("z", *place, id), report.selectExpr("z", *place, "kept", "dropped")


def tile_join(layers: DataFrame, archives: dict[str, str], layer: str = "layer") -> DataFrame:
    """Name the archive each layer belongs to; a layer without one is an error."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in archives.items())
    unknown = f"raise_error(concat('no archive for layer ', coalesce({layer}, 'NULL')))"
    return layers.selectExpr("*", f"coalesce(try_element_at(map({pairs}), {layer}), {unknown}) AS archive")
