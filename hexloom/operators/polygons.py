"""Polygons as edge tables: area, centroid, length, and the cut into grid buckets.

A polygon row is ``(key, rings)`` with ``rings: array<array<struct<x, y>>>``, outer ring first. The
edge table ``(key, x1, y1, x2, y2)`` keeps the interior to the left of every edge, so plain signed
sums over edges give areas, and every further operator is a keyed join plus an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.numeric import num

EDGE = ("x1", "y1", "x2", "y2")
#: Overlaps below this many square metres count as mere contact.
MIN_OVERLAP_M2 = 1e-6


def explode_parts(multi: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """Multi-part polygons (array of ring arrays) to one row per part: (key, part, rings)."""
    rest = [c for c in multi.columns if c not in (key, parts)]
    return multi.select(key, *rest, F.posexplode(parts).alias("part", "rings")).filter(
        F.size("rings") > 0
    )


def polygon_members(collection: DataFrame, geom_type: str = "geom_type") -> DataFrame:
    """Keep the polygon members of exploded geometry collections."""
    return collection.filter(F.col(geom_type).isin("POLYGON", "MULTIPOLYGON"))


def edges(polygons: DataFrame, key: str, rings: str = "rings", keep: tuple = ()) -> DataFrame:
    """Rings to oriented edges; outer rings become counter-clockwise and holes clockwise.

    A repeated closing vertex yields a zero-length edge, which is dropped. ``ox, oy`` carry the
    polygon's first vertex as a local origin for sums that would otherwise cancel badly. Polygons are
    dealt anew by their rings: a small file is one task, whatever its shapes are cut into later.
    """

    corner = "get(r, (i + 1) % size(r))"
    ring_edges = (
        f"transform({rings}, r -> transform(r, (p, i) -> named_struct("
        f"'x1', double(p.x), 'y1', double(p.y), 'x2', double({corner}.x), 'y2', double({corner}.y))))"
    )
    first = f"get(get({rings}, 0), 0)"
    exploded = polygons.select(key, *keep, rings).repartition(rings).selectExpr(
        key, *keep, f"double({first}.x) AS ox", f"double({first}.y) AS oy",
        f"posexplode({ring_edges}) AS (ring, _edges)",
    )
    turn = "aggregate(_edges, 0D, (acc, e) -> acc + (e.x1 - e.x2) * (e.y1 + e.y2 - 2 * oy))"
    return (
        exploded.selectExpr(
            key, *keep, "ring", "ox", "oy", f"(ring = 0) != ({turn} >= 0) AS _flip", "explode(_edges) AS _e"
        )
        .selectExpr(
            key, *keep, "ring", "ox", "oy",
            "if(_flip, _e.x2, _e.x1) AS x1", "if(_flip, _e.y2, _e.y1) AS y1",
            "if(_flip, _e.x1, _e.x2) AS x2", "if(_flip, _e.y1, _e.y2) AS y2",
        )
        .filter("x1 != x2 OR y1 != y2")
    )


def with_origin(edge_table: DataFrame, key: str) -> DataFrame:
    """Give edges without a local origin one per key (lower left corner)."""
    corner = edge_table.groupBy(key).agg(F.min("x1").alias("ox"), F.min("y1").alias("oy"))
    return edge_table.drop("ox", "oy").join(corner, key)


def polygon_area(edge_table: DataFrame, key: str) -> DataFrame:
    """(key, area_m2) as a signed sum over edges; holes subtract themselves."""
    return edge_table.groupBy(key).agg(
        F.expr("sum((x1 - x2) * ((y1 - oy) + (y2 - oy)) / 2)").alias("area_m2")
    )


def polygon_centroid(edge_table: DataFrame, key: str) -> DataFrame:
    """(key, x, y) area-weighted centroid."""
    local = edge_table.selectExpr(
        f"{key} AS _key", "ox", "oy", "x1 - ox AS ax", "y1 - oy AS ay", "x2 - ox AS bx", "y2 - oy AS by"
    ).selectExpr("*", "ax * by - bx * ay AS c")
    sums = local.groupBy("_key").agg(
        *[
            F.expr(e)
            for e in (
                "sum(c) AS c", "sum((ax + bx) * c) AS sx", "sum((ay + by) * c) AS sy",
                "min(ox) AS ox", "min(oy) AS oy",
            )
        ]
    )
    return sums.selectExpr(
        f"_key AS {key}", "ox + try_divide(sx, c * 3) AS x", "oy + try_divide(sy, c * 3) AS y"
    )


def outline_length(edge_table: DataFrame, key: str) -> DataFrame:
    """(key, edge_count, length_m) of an edge table."""
    return edge_table.groupBy(key).agg(
        F.expr("count(1) AS edge_count"),
        F.expr("sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS length_m"),
    )


def scan_spans(edge_table: DataFrame, key: str, step: float) -> DataFrame:
    """Spans of every horizontal line y = k * step inside each polygon: (key, k, xa, xb, w).

    An edge crosses the lines with y_low < k * step <= y_high; the running sum of crossing
    directions from the left is the winding number, and spans with a non-zero sum are inside. The
    window groups are single lines of single polygons, so a huge polygon spreads over its lines.
    """
    h = num(step)
    own, key = key, "_key"  # no clash between the caller's key name and working columns
    line = f"OVER (PARTITION BY {key}, k ORDER BY xa"
    return (
        edge_table.withColumnRenamed(own, key)
        .selectExpr(
            key, *EDGE, f"floor(least(y1, y2) / {h}) + 1 AS a", f"floor(greatest(y1, y2) / {h}) AS z"
        )
        .filter("a <= z")
        .selectExpr(key, *EDGE, "explode(sequence(a, z)) AS k")
        .selectExpr(
            key,
            "k",
            f"x1 + (k * {h} - y1) * (x2 - x1) / (y2 - y1) AS xa",
            "if(y2 < y1, 1, -1) AS d",
        )
        .selectExpr(
            key,
            "k",
            "xa",
            f"lead(xa) {line}) AS xb",
            f"double(sum(d) {line} ROWS UNBOUNDED PRECEDING)) AS w",
        )
        .filter("w != 0 AND xb > xa")
        .withColumnRenamed(key, own)
    )


def cut_to_grid(edge_table: DataFrame, key: str, side: float) -> DataFrame:
    """Cut polygons by a square grid into signed slabs: (key, bx, by, s, x1, y1, x2, y2).

    Inside bucket (bx, by) the polygon equals the signed sum of the regions *below* its slabs, in
    coordinates local to the bucket. Slabs are the edge parts inside the bucket plus lids: the parts
    of the bucket's top line that lie inside the polygon. A bucket wholly inside is one full lid.
    No slab needs anything outside its bucket, so area, containment and overlap become joins on the
    bucket alone, and work grows with outline length plus covered buckets, not with edge products.
    """
    h = num(side)
    own, key = key, "_key"
    edge_table = edge_table.withColumnRenamed(own, key)
    # Edge parts, first by bucket column, then by bucket row.
    columns = (
        edge_table.filter("x1 != x2")
        .selectExpr(
            key,
            "if(x1 < x2, -1D, 1D) AS s",
            "least(x1, x2) AS xl",
            "if(x1 < x2, y1, y2) AS yl",
            "greatest(x1, x2) AS xr",
            "if(x1 < x2, y2, y1) AS yr",
        )
        .selectExpr(
            "*",
            "(yr - yl) / (xr - xl) AS m",
            f"explode(sequence(floor(xl / {h}), ceil(xr / {h}) - 1)) AS bx",
        )
        .selectExpr("*", f"greatest(xl, bx * {h}) AS l", f"least(xr, (bx + 1) * {h}) AS r")
        .selectExpr(
            key,
            "s",
            "bx",
            f"l - bx * {h} AS xa",
            f"r - bx * {h} AS xb",
            "if(l = xl, yl, yl + m * (l - xl)) AS ya",
            "if(r = xr, yr, yl + m * (r - xl)) AS yb",
        )
    )

    def clamp(value: str, top: str) -> str:
        return f"least(greatest({value}, 0D), {top})"

    local = (
        columns.selectExpr(
            "*",
            f"explode(sequence(floor(least(ya, yb) / {h}), floor(greatest(ya, yb) / {h}))) AS by",
        )
        .selectExpr(
            key, "s", "bx", "by", "xa", "xb", f"ya - by * {h} AS ya", f"yb - by * {h} AS yb"
        )
        .selectExpr(
            "*",
            f"if(ya = yb, 0D, {clamp('-ya / (yb - ya)', '1D')}) AS p",
            f"if(ya = yb, 1D, {clamp(f'({h} - ya) / (yb - ya)', '1D')}) AS q",
        )
        .selectExpr("*", "least(p, q) AS t", "greatest(p, q) AS u")
        .selectExpr(
            key,
            "bx",
            "by",
            "s",
            "xa + (xb - xa) * t AS x1",
            f"{clamp('ya + (yb - ya) * t', h)} AS y1",
            "xa + (xb - xa) * u AS x2",
            f"{clamp('ya + (yb - ya) * u', h)} AS y2",
        )
    )
    lids = (
        scan_spans(edge_table, key, side)
        .selectExpr("*", f"explode(sequence(floor(xa / {h}), ceil(xb / {h}) - 1)) AS bx")
        .selectExpr(
            key,
            "bx",
            "k - 1 AS by",
            "w AS s",
            f"greatest(xa - bx * {h}, 0D) AS x1",
            f"{h} AS y1",
            f"least(xb - bx * {h}, {h}) AS x2",
            f"{h} AS y2",
        )
    )
    return local.unionByName(lids).filter("x2 > x1").withColumnRenamed(key, own)


def slab_area(slabs: DataFrame, key: str, name: str = "area_m2") -> DataFrame:
    """(key, area) of slab sets."""
    return slabs.groupBy(key).agg(F.expr("sum(s * (x2 - x1) * (y1 + y2) / 2)").alias(name))
