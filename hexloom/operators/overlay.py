"""Containment, overlap and clipping on slabs (see ``polygons.cut_to_grid``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexloom.functions.hexgrid import hex_boundary
from hexloom.functions.numeric import num
from hexloom.operators.polygons import MIN_OVERLAP_M2, cut_to_grid, slab_area
from hexloom.session import settle

SLAB = ("s", "x1", "y1", "x2", "y2")
#: Counted points: the fewest in a block, rows of a group, and places looked at side by side.
SITES_PER_CELL, GROUP, STEP = 32, 1 << 16, 1 << 20


def _height(x: str, slab: str = "", tail: str = "") -> str:
    """Height of a slab at ``x``; ``slab`` and ``tail`` qualify its column names."""
    x1, y1, x2, y2 = (f"{slab}{c}{tail}" for c in SLAB[1:])
    return f"({y1} + ({y2} - {y1}) * ({x} - {x1}) / ({x2} - {x1}))"


def polygon_cover(edge_table: DataFrame, key: str, side: float) -> DataFrame:
    """Disjoint pieces of each polygon per bucket, as ``slab_trapezoids`` gives them."""
    return slab_trapezoids(cut_to_grid(edge_table, key, side), key)


def points_in_polygons(
    points: DataFrame,
    edge_table: DataFrame,
    key: str,
    side: float,
    x: str = "x",
    y: str = "y",
    keep_outside: bool = False,
    counted: bool = False,
) -> DataFrame:
    """Points with the key of each polygon holding them; points outside every polygon drop out, or have no key.

    With ``counted``, only how many points a polygon holds: (key, n), to be added up. Its work follows the
    outlines and not the pairs, of which there are points times polygons where many polygons overlap.

    Half-open rule on outlines: lower and left edges belong to the polygon, upper and right ones do
    not, so a coverage never claims a point twice. The cover is settled, so Spark knows its bytes and
    broadcasts it below its own threshold; beyond that the join shuffles on the bucket.
    """
    h = num(side)
    located = points.selectExpr("*", f"floor({x} / {h}) AS bx", f"floor({y} / {h}) AS by")
    px, py = f"({x} - bx * {h})", f"({y} - by * {h})"
    if counted:
        return _counted(located.selectExpr("bx", "by", f"{px} AS px", f"{py} AS py"), polygon_cover(edge_table, key, side), key, side)
    cover = settle(polygon_cover(edge_table, key, side), "cover")
    # Pieces are disjoint, so a point meets one at most and needs no regrouping.
    cover = cover.withColumnsRenamed({"bx": "_bx", "by": "_by"})
    holds = (
        f"bx = _bx AND by = _by AND {px} >= xa AND {px} < xb AND {py} < {_height(px, 'top.')} "
        f"AND (low IS NULL OR {py} >= {_height(px, 'low.')})"
    )
    found = located.join(cover, F.expr(holds), "left" if keep_outside else "inner")
    return found.drop("bx", "by", "_bx", "_by", "xa", "xb", "top", "low")


def _counted(located: DataFrame, cover: DataFrame, key: str, side: float) -> DataFrame:
    """(key, n) of points (bx, by, px, py) in the disjoint pieces of polygons, in parts that add up.

    Points and pieces are shuffled once, to units of a bucket with at most about ``GROUP`` of each; a bucket
    with more of them is several units, in which every part of its points meets every part of its pieces.
    Tasks take ``GROUP`` points of many units at a time. What a piece holds there is told by ``_unit_counts``.
    """
    own, key = key, "_key"  # no clash between the caller's key name and working columns
    cover = cover.withColumnRenamed(own, key)
    # A piece lies in 0 <= x < h; a place a rounding below y = 0 is held where a piece has no lower line.
    inside = located.filter(f"px >= 0D AND px < {num(side)} AND py < {num(side)}")
    inside = settle(inside.withColumn("row", F.monotonically_increasing_id()), "located")
    cover = settle(cover.withColumn("row", F.monotonically_increasing_id()), "pieces")

    # Parts of the points and of the pieces of each bucket that has both.
    grid = inside.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("k")).join(
        cover.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("m")), ["bx", "by"]
    )
    grid = settle(grid.selectExpr("bx", "by", f"ceil(k / {GROUP}) AS parts", f"ceil(m / {GROUP}) AS shares", "k", "m"), "grid")
    rows = grid.agg(F.expr("sum(greatest(k * shares, m * parts))")).first()[0] or 0
    groups = max(1, -(-rows // GROUP))

    def dealt(unit: str, *columns: str) -> list[str]:
        return [f"cast(pmod(xxhash64(bx, by, {unit}), {groups}) as int) AS g", "bx", "by", f"{unit} AS unit", *columns]

    points = inside.join(grid, ["bx", "by"]).selectExpr("*", "explode(sequence(0, shares - 1)) AS share")
    points = points.selectExpr(*dealt("pmod(row, parts) * shares + share", "px", "py"))
    lines = [f"{line}.{c} AS {line}_{c}" for line in ("top", "low") for c in SLAB[1:]]
    pieces = cover.join(grid, ["bx", "by"]).selectExpr("*", "explode(sequence(0, parts - 1)) AS part")
    pieces = pieces.selectExpr(*dealt("part * shares + pmod(row, shares)", key, "xa", "xb", *lines))
    schema = T.StructType([cover.schema[key], T.StructField("below", T.LongType()), T.StructField("tested", T.LongType())])
    counts = points.groupBy("g").cogroup(pieces.groupBy("g")).applyInArrow(_unit_counts(side, SITES_PER_CELL), schema)
    return counts.groupBy(key).agg(F.expr("sum(below + tested) AS n")).withColumnRenamed(key, own)


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places from ``start`` to before ``stop`` of each row."""
    sizes = np.maximum(stop - start, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - start, sizes)


def _unit_counts(side: float, sites: float):
    """(key, below, tested) of each piece that holds points: how many were told by blocks, and one by one.

    The points of a unit in rising x are cut into blocks, and each block is ordered by y. In a block that a
    piece spans, binary searches tell the points between its two lines; only points beside a sloping line
    and those of the blocks where the piece begins or ends are tested, by the rule of ``points_in_polygons``.
    """

    def run(points: pa.Table, pieces: pa.Table) -> pa.Table:
        n, m = len(points), len(pieces)
        if not n or not m:
            return pa.table({"_key": pieces.column("_key")[:0], "below": pa.array([], pa.int64()), "tested": pa.array([], pa.int64())})
        px, py = (points.column(c).to_numpy() for c in ("px", "py"))
        unit = np.zeros(n + m, np.int64)
        for c in ("bx", "by", "unit"):
            values = np.unique(np.concatenate([t.column(c).to_numpy() for t in (points, pieces)]), return_inverse=True)[1]
            unit = np.unique(unit * (n + m) + values, return_inverse=True)[1]
        # A line's parts x1, y1, x2, y2; where there is no lower one, all points are over it.
        top, low = ([pieces.column(f"{line}_{c}").to_numpy() for c in SLAB[1:]] for line in ("top", "low"))
        floor = pieces.column("low_x1").is_null().to_numpy()

        # Ranks in place of values, so that one search serves all units.
        order = np.lexsort((px, unit[:n]))
        own, px, py = unit[:n][order], px[order], py[order]
        xs, ys = np.unique(px), np.unique(py)
        at = own * (len(xs) + 1) + np.searchsorted(xs, px)
        begin, end = (np.searchsorted(at, unit[n:] * (len(xs) + 1) + np.searchsorted(xs, pieces.column(c).to_numpy())) for c in ("xa", "xb"))
        block = max(1, int(max(sites, np.sqrt(8 * n / len(np.unique(own))))))
        order = np.lexsort((py, np.arange(n) // block))
        bx, by = px[order], py[order]
        at = np.arange(n) // block * (len(ys) + 1) + np.searchsorted(ys, by)
        left, right = px[::block], px[np.minimum(np.arange(block - 1, n + block - 1, block), n - 1)]
        first, last = -(-begin // block), end // block
        head = np.minimum(first * block, end)
        below, tested = np.zeros(m, np.int64), np.zeros(m, np.int64)

        def height(line: list[np.ndarray], p: np.ndarray, x: np.ndarray) -> np.ndarray:
            x1, y1, x2, y2 = (v[p] for v in line)
            return y1 + (y2 - y1) * (x - x1) / (x2 - x1)

        def test(now: slice, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            held = (y < height(top, p, x)) & (floor[p] | (y >= height(low, p, x)))
            tested[now] += np.bincount(p[held] - now.start, minlength=now.stop - now.start)

        def bounds(line: list[np.ndarray], p: np.ndarray, k: np.ndarray, none: np.ndarray | None) -> list[np.ndarray]:
            """Places in the blocks before which all points are below the line, and from which none is."""
            ends = [height(line, p, v[k]) for v in (left, right)]
            # Lines may be evaluated a rounding aside of their ends.
            margin = np.where(line[1][p] == line[3][p], 0.0, side * 1e-9)
            out = []
            for value in (np.minimum(*ends) - margin, np.maximum(*ends) + margin):
                value = value if none is None else np.where(none[p], -np.inf, value)
                out.append(np.searchsorted(at, k * (len(ys) + 1) + np.searchsorted(ys, value)))
            return out

        # So many pieces at a time that what they meet stays small.
        cost = np.cumsum(np.maximum(last - first, 0) + (head - begin) + np.maximum(end - np.maximum(last * block, head), 0))
        cuts = np.unique(np.r_[0, np.searchsorted(cost, np.arange(STEP, cost[-1] + 1, STEP), side="right"), m])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = slice(lo, hi)
            for start, stop in ((begin[now], head[now]), (np.maximum(last * block, head)[now], end[now])):
                p, i = _spread(start, stop)
                test(now, p + lo, px[i], py[i])
            p, k = _spread(first[now], last[now])
            p += lo
            (a, b), (c, d) = bounds(low, p, k, floor), bounds(top, p, k, None)
            below[now] += np.bincount(p - lo, np.maximum(c - b, 0), hi - lo).astype(np.int64)
            for start, stop in ((a, np.minimum(b, d)), (np.maximum(np.maximum(a, b), c), d)):
                for part in range(0, len(p), STEP // block + 1):
                    q, i = _spread(start[part : part + STEP // block + 1], stop[part : part + STEP // block + 1])
                    test(now, p[q + part], bx[i], by[i])
        some = np.flatnonzero(below + tested)
        return pa.table({"_key": pieces.column("_key").take(pa.array(some)), "below": below[some], "tested": tested[some]})

    return run


def _slab_pairs(a: DataFrame, key_a: str, b: DataFrame, key_b: str, hint: str | None = None) -> DataFrame:
    """Pairs of slabs of one bucket that share an x-range (l, r), with the heights at its ends.

    ``dl`` and ``dr`` are the heights of a above b at both ends. ``hint`` names the join where Spark's own
    choice would go by sizes from before the cut.
    """
    left = a.selectExpr("bx", "by", f"{key_a} AS ka", *[f"{c} AS {c}_a" for c in SLAB])
    right = b.selectExpr("bx", "by", f"{key_b} AS kb", *[f"{c} AS {c}_b" for c in SLAB])
    right = right.hint(hint) if hint else right
    return (
        left.join(right, ["bx", "by"])
        .filter("x1_a < x2_b AND x1_b < x2_a")
        .selectExpr("*", "greatest(x1_a, x1_b) AS l", "least(x2_a, x2_b) AS r")
        .selectExpr(
            "ka",
            "kb",
            "bx",
            "by",
            "s_a * s_b AS s",
            "l",
            "r",
            f"{_height('l', tail='_a')} AS al",
            f"{_height('r', tail='_a')} AS ar",
            f"{_height('l', tail='_b')} AS bl",
            f"{_height('r', tail='_b')} AS br",
        )
        .selectExpr("*", "al - bl AS dl", "ar - br AS dr")
    )


def slab_overlap_area(
    a: DataFrame, key_a: str, b: DataFrame, key_b: str, name: str = "area_m2", hint: str | None = None
) -> DataFrame:
    """(key_a, key_b, area) of every pair with positive common area, from two slab sets."""
    # Area below a, less the part of it that lies above b.
    above = (
        "CASE WHEN dl >= 0 AND dr >= 0 THEN (r - l) * (dl + dr) / 2 "
        "WHEN dl <= 0 AND dr <= 0 THEN 0D "
        "ELSE (r - l) * greatest(dl, dr) * greatest(dl, dr) / (abs(dl) + abs(dr)) / 2 END"
    )
    return (
        _slab_pairs(a, key_a, b, key_b, hint)
        .groupBy(F.col("ka").alias(key_a), F.col("kb").alias(key_b))
        .agg(F.expr(f"sum(s * ((r - l) * (al + ar) / 2 - {above}))").alias(name))
        .filter(f"{name} > {num(MIN_OVERLAP_M2)}")
    )


def polygon_overlap_area(
    a: DataFrame, key_a: str, b: DataFrame, key_b: str, side: float, hint: str | None = None
) -> DataFrame:
    """(key_a, key_b, area_m2) of every pair of polygons with positive common area.

    Both edge tables are cut by the same grid and meet on the bucket only: no cross join, no list of
    candidate pairs, and pairs of far edges of two large polygons never meet.
    """
    return slab_overlap_area(
        cut_to_grid(a, key_a, side), key_a, cut_to_grid(b, key_b, side), key_b, hint=hint
    )


def clip_slabs(a: DataFrame, key: str, b: DataFrame, key_b: str) -> DataFrame:
    """Slabs of every polygon of ``a`` cut to the union of the disjoint regions ``b``.

    The region below two slabs is the region below the lower of the two, so the result is again a
    slab set: one slab where the two do not cross, two where they do.
    """
    halves = (
        "array(named_struct('x1', l, 'y1', zl, 'x2', x, 'y2', y), "
        "named_struct('x1', x, 'y1', y, 'x2', r, 'y2', zr))"
    )
    return (
        _slab_pairs(a, key, b, key_b)
        .selectExpr(
            "*",
            "if(dl * dr < 0, dl / (dl - dr), NULL) AS t",
            "least(al, bl) AS zl",
            "least(ar, br) AS zr",
        )
        .selectExpr("*", "l + (r - l) * t AS x", "al + (ar - al) * t AS y")
        .selectExpr(
            f"ka AS {key}",
            "bx",
            "by",
            "s",
            f"inline(if(t IS NULL, array(named_struct('x1', l, 'y1', zl, 'x2', r, 'y2', zr)), {halves}))",
        )
        .filter("x2 > x1")
        # Slabs along a common inner border cancel; merging equals keeps the sets small.
        .groupBy(key, "bx", "by", "x1", "y1", "x2", "y2")
        .agg(F.sum("s").alias("s"))
        .filter("s != 0")
        .select(key, "bx", "by", *SLAB)
    )


def clip_to_boundary(
    edge_table: DataFrame, key: str, boundary: DataFrame, boundary_key: str, side: float
) -> DataFrame:
    """Slabs of the polygons cut to the boundary; polygons outside it vanish."""
    return clip_slabs(
        cut_to_grid(edge_table, key, side),
        key,
        cut_to_grid(boundary, boundary_key, side),
        boundary_key,
    )


def slab_trapezoids(slabs: DataFrame, key: str) -> DataFrame:
    """Disjoint pieces that make up each slab set: (key, bx, by, xa, xb, top, low).

    Slab ends split a bucket into vertical strips; inside a strip the slabs are ordered by height
    and the running sign from the top tells which gaps are inside. A piece spans xa to xb between
    the lines ``top`` and ``low`` (the bucket floor where NULL). Windows span one strip of one
    polygon in one bucket.
    """
    bucket = f"{key}, bx, by"
    strips = (
        slabs.selectExpr(key, "bx", "by", "explode(array(x1, x2)) AS xa")
        .distinct()
        .selectExpr("*", f"lead(xa) OVER (PARTITION BY {bucket} ORDER BY xa) AS xb")
        .filter("xb IS NOT NULL")
    )
    line = f"OVER (PARTITION BY {bucket}, xa ORDER BY h DESC"
    return (
        strips.join(slabs, [key, "bx", "by"])
        .filter("x1 <= xa AND x2 >= xb")
        .selectExpr(
            key, "bx", "by", "xa", "xb", "s", f"{_height('xa')} + {_height('xb')} AS h",
            "struct(x1, y1, x2, y2) AS top",
        )
        .selectExpr(
            "*",
            f"sum(s) {line} ROWS UNBOUNDED PRECEDING) AS w",
            f"lead(top) {line}) AS low",
            f"coalesce(lead(h) {line}), 0D) AS h_low",
        )
        .filter("w > 0.5D AND h > h_low")
        .select(key, "bx", "by", "xa", "xb", "top", "low")
    )


def trapezoid_rings(pieces: DataFrame, key: str, side: float) -> DataFrame:
    """(key, ring) of each piece: the geometry form of a clipped polygon."""
    h = num(side)

    def corner(x: str, slab: str) -> str:
        height = f"if({slab} IS NULL, 0D, {_height(x, slab + '.')})"
        return f"named_struct('x', bx * {h} + {x}, 'y', by * {h} + {height})"

    ring = ", ".join(corner(x, s) for x, s in (("xa", "low"), ("xb", "low"), ("xb", "top"), ("xa", "top")))
    return pieces.selectExpr(key, f"array({ring}) AS ring")


def _cut_side(ring: str, a: str, b: str) -> str:
    """The part of a ring on or left of the line from ``a`` to ``b``, as SQL text."""

    def left_of(point: str) -> str:
        return f"({b}.x - {a}.x) * ({point}.y - {a}.y) - ({b}.y - {a}.y) * ({point}.x - {a}.x)"

    # Sides p to q of the ring, with the heights of both ends over the line.
    sides = (
        f"transform(transform({ring}, (q, j) -> struct(element_at({ring}, if(j = 0, -1, j)) AS p, q AS q)), "
        f"e -> struct(e.p AS p, e.q AS q, {left_of('e.p')} AS dp, {left_of('e.q')} AS dq))"
    )
    crossing = (
        "CASE WHEN (e.dp >= 0D) != (e.dq >= 0D) THEN array(named_struct("
        "'x', e.p.x + (e.q.x - e.p.x) * (e.dp / (e.dp - e.dq)), 'y', e.p.y + (e.q.y - e.p.y) * (e.dp / (e.dp - e.dq)))) "
        "ELSE filter(array(e.q), v -> false) END"
    )
    return f"flatten(transform({sides}, e -> concat({crossing}, filter(array(e.q), v -> e.dq >= 0D))))"


def clip_rings_to_cell(pairs: DataFrame, key: str, cell: str = "cell", rings: str = "rings") -> DataFrame:
    """Rings of each polygon cut to a hexagonal cell: (key, cell, rings).

    ``pairs`` has one row per (polygon, cell). Cells are convex, so each ring is cut on its own, side
    after side of the cell; bridges along the cell side cancel in signed sums. No shuffle, no Python.
    """
    cut = _cut_side("ring", "element_at(_corners, i + 1)", "element_at(_corners, (i + 1) % 6 + 1)")
    clipped = f"transform({rings}, r -> aggregate(sequence(0, 5), r, (ring, i) -> {cut}))"
    return (
        pairs.selectExpr(key, cell, rings, f"{hex_boundary(cell)} AS _corners")
        .selectExpr(key, cell, f"filter({clipped}, r -> size(r) > 2) AS rings")
        .filter("size(rings) > 0")
    )


__all__ = [
    "clip_rings_to_cell",
    "clip_slabs",
    "clip_to_boundary",
    "points_in_polygons",
    "polygon_cover",
    "polygon_overlap_area",
    "slab_area",
    "slab_overlap_area",
    "slab_trapezoids",
    "trapezoid_rings",
]
