"""Unions of polygons as outline edges, and outline edges as rings and shapes.

``dissolve`` takes any polygons, not only clean coverages: edges are split where vertices of others lie
on them and where they cross, equal pieces cancel, and a piece is outline if exactly one of its sides is
covered. ``trace`` orders outline edges into rings by pointer doubling, so neither a ring nor an outline
ever has to fit in one task before its text is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.numeric import num
from hexloom.operators.overlay import points_in_polygons
from hexloom.operators.polygons import EDGE, cut_to_grid
from hexloom.session import settle

#: Metres below which a vertex lies on an edge; crossings are placed on a grid this fine.
TOLERANCE = 1e-6
#: Distance from an edge at which its sides are probed.
ASIDE = 1e-7
SIDE = 250.0
_TURNED = ("x2", "y2", "x1", "y1")
#: Vertices of a ring that are put into one piece of text.
PIECE = 512


def _net(pieces: DataFrame, key: str) -> DataFrame:
    """Edges from left to right (or bottom to top) with ``d``, how many more run this way than back."""
    return (
        pieces.filter("x1 != x2 OR y1 != y2")
        .selectExpr(key, *EDGE, "d", "x1 < x2 OR (x1 = x2 AND y1 < y2) AS f")
        .selectExpr(key, *[f"if(f, {c}, {o}) AS {c}" for c, o in zip(EDGE, _TURNED)], "if(f, d, -d) AS d")
        .groupBy(key, *EDGE)
        .agg(F.sum("d").alias("d"))
        .filter("d != 0")
    )


def cancel_shared(edge_table: DataFrame, key: str) -> DataFrame:
    """Outline edges per key of a coverage whose neighbours share vertices: shared edges cancel.

    Each undirected edge is one group, so the shuffle spreads over all edges however large a single
    outline is.
    """
    net = _net(edge_table.selectExpr(key, *EDGE, "1 AS d"), key)
    return net.selectExpr(key, *[f"if(d > 0, {c}, {o}) AS {c}" for c, o in zip(EDGE, _TURNED)])


def _touched(net: DataFrame, side: float) -> DataFrame:
    """Net edges once per grid bucket that they come within the tolerance of."""
    h, e = num(side), num(TOLERANCE)
    slope = "coalesce(try_divide(y2 - y1, x2 - x1), 0D)"
    return (
        net.selectExpr("*", f"explode(sequence(floor((x1 - {e}) / {h}), floor((x2 + {e}) / {h}))) AS bx")
        .selectExpr("*", f"least(greatest(x1, bx * {h} - {e}), x2) AS l", f"greatest(least(x2, (bx + 1) * {h} + {e}), x1) AS r")
        .selectExpr(
            "*", f"if(l = x1, y1, y1 + {slope} * (l - x1)) AS ya", f"if(r = x2, y2, y1 + {slope} * (r - x1)) AS yb"
        )
        .selectExpr(
            "*", f"explode(sequence(floor((least(ya, yb) - {e}) / {h}), floor((greatest(ya, yb) + {e}) / {h}))) AS by"
        )
        .drop("l", "r", "ya", "yb")
    )


def split_points(net: DataFrame, key: str, side: float = SIDE) -> DataFrame:
    """(key, x1, y1, x2, y2, t, px, py, crossing): where net edges must be split, ``t`` metres along them.

    A vertex of another edge on the edge is taken as it is; a crossing is computed from the smaller of the
    two edges and snapped, so both get the same point. Edges meet in grid buckets only. Both sides grow while
    they are exploded, which Spark's estimate misses, so neither may be broadcast.
    """
    e = num(TOLERANCE)
    a = _touched(net, side).drop("d")
    b = a.selectExpr(key, "bx", "by", "x1 AS u1", "y1 AS v1", "x2 AS u2", "y2 AS v2")
    near = (
        f"(x1 != u1 OR y1 != v1 OR x2 != u2 OR y2 != v2) AND x1 <= u2 + {e} AND u1 <= x2 + {e} "
        f"AND least(y1, y2) <= greatest(v1, v2) + {e} AND least(v1, v2) <= greatest(y1, y2) + {e}"
    )
    met = (
        a.join(b.hint("merge"), [key, "bx", "by"])
        .filter(near)
        .selectExpr(
            key, *EDGE, "u1", "v1", "u2", "v2", "x2 - x1 AS dx", "y2 - y1 AS dy", "u2 - u1 AS ex", "v2 - v1 AS ey",
            "u1 - x1 AS wx", "v1 - y1 AS wy", "u2 - x1 AS zx", "v2 - y1 AS zy",
        )
        .selectExpr("*", "sqrt(dx * dx + dy * dy) AS la", "sqrt(ex * ex + ey * ey) AS lb", "dx * ey - dy * ex AS den")
        .selectExpr(
            "*", "(wx * dx + wy * dy) / la AS t1", "abs(dx * wy - dy * wx) / la AS o1",
            "(zx * dx + zy * dy) / la AS t2", "abs(dx * zy - dy * zx) / la AS o2",
            "abs(ex * wy - ey * wx) / lb AS q1", "abs(ex * (y2 - v1) - ey * (x2 - u1)) / lb AS q2",
            "try_divide(wx * ey - wy * ex, den) AS ta", "try_divide(wx * dy - wy * dx, den) AS tb",
        )
    )

    def on(t: str, length: str) -> str:
        return f"{t} > {e} AND {t} < {length} - {e}"

    first = "struct(x1, y1, x2, y2) < struct(u1, v1, u2, v2)"
    snapped = {c: f"floor(if({first}, {p} + ta * {v}, {q} + tb * {w}) / {e} + 0.5D) * {e}" for c, p, v, q, w in (
        ("px", "x1", "dx", "u1", "ex"), ("py", "y1", "dy", "v1", "ey"))}
    crossing = f"o1 > {e} AND o2 > {e} AND q1 > {e} AND q2 > {e} AND {on('ta * la', 'la')} AND {on('tb * lb', 'lb')}"
    points = (
        f"array(if(o1 <= {e} AND {on('t1', 'la')}, named_struct('t', t1, 'px', u1, 'py', v1, 'crossing', false), NULL), "
        f"if(o2 <= {e} AND {on('t2', 'la')}, named_struct('t', t2, 'px', u2, 'py', v2, 'crossing', false), NULL), "
        f"if({crossing}, named_struct('t', ta * la, 'px', {snapped['px']}, 'py', {snapped['py']}, 'crossing', true), NULL))"
    )
    found = met.selectExpr(key, *EDGE, f"inline(array_compact({points}))")
    return found.groupBy(key, *EDGE, "px", "py").agg(F.min("t").alias("t"), F.expr("bool_and(crossing) AS crossing"))


def noded(edge_table: DataFrame, key: str, side: float = SIDE) -> DataFrame:
    """Net edges (key, x1, y1, x2, y2, d) that meet others in common end points only."""
    # Settled, as several branches of the plan start here.
    net = settle(_net(edge_table.selectExpr(key, *EDGE, "1 AS d"), key), "net")
    cuts = split_points(net, key, side)
    ends = net.selectExpr(key, *EDGE, "d", "inline(array(struct(-1D AS t, x1 AS px, y1 AS py), struct(double('inf') AS t, x2 AS px, y2 AS py)))")
    # A split point knows its edge but not its count; the running maximum brings it from the start point.
    along = f"OVER (PARTITION BY {key}, x1, y1, x2, y2 ORDER BY t, px, py)"
    pieces = (
        ends.unionByName(cuts.selectExpr(key, *EDGE, "cast(NULL as bigint) AS d", "t", "px", "py"))
        .selectExpr(key, f"first(d) {along} AS d", "px", "py", f"lead(px) {along} AS nx", f"lead(py) {along} AS ny")
        .filter("nx IS NOT NULL")
        .selectExpr(key, "px AS x1", "py AS y1", "nx AS x2", "ny AS y2", "d")
    )
    return _net(pieces, key)


def dissolve(edge_table: DataFrame, key: str, side: float = SIDE) -> DataFrame:
    """Outline edges of the union per key, the covered side on the left.

    Works for any polygons of a key: neighbours whose vertices don't match, overlaps, gaps and holes.
    Points covered once or more are inside. The sides of a piece are probed beside its middle, against
    the pieces of the same grid bucket only; ``side`` should be a few edge lengths.
    """
    h, aside = num(side), num(ASIDE)
    pieces = settle(noded(edge_table, key, side), "pieces")
    copies = pieces.selectExpr(
        key, *[f"if(d > 0, {c}, {o}) AS {c}" for c, o in zip(EDGE, _TURNED)], "explode(sequence(1L, abs(d))) AS copy"
    ).drop("copy")
    slabs = cut_to_grid(copies, key, side).selectExpr(
        key, "bx", "by", "s", "x1 AS sx1", "y1 AS sy1", "x2 AS sx2", "y2 AS sy2"
    )
    length = "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
    probes = (
        pieces.selectExpr(
            "*", f"(x1 + x2) / 2 - (y2 - y1) / {length} * {aside} AS qx", f"(y1 + y2) / 2 + (x2 - x1) / {length} * {aside} AS qy"
        )
        .selectExpr("*", f"floor(qx / {h}) AS bx", f"floor(qy / {h}) AS by")
        .selectExpr("*", f"qx - bx * {h} AS lx", f"qy - by * {h} AS ly")
    )
    above = F.expr(
        f"p.{key} <=> s.{key} AND p.bx = s.bx AND p.by = s.by AND lx >= sx1 AND lx < sx2 "
        "AND sy1 + (sy2 - sy1) * (lx - sx1) / (sx2 - sx1) > ly"
    )
    sides = (
        probes.alias("p").join(slabs.alias("s"), above, "left")
        .groupBy(f"p.{key}", *EDGE, "d").agg(F.expr("cast(round(coalesce(sum(s), 0D)) as bigint) AS left"))
        .filter("(left > 0) != (left - d > 0)")
    )
    return sides.selectExpr(key, *[f"if(left > 0, {c}, {o}) AS {c}" for c, o in zip(EDGE, _TURNED)])


def coverage_check(edge_table: DataFrame, key: str, side: float = SIDE) -> DataFrame:
    """(key, open_vertices, t_junctions, crossings) of polygons or outlines.

    Open vertices are entered and left unequally often, T-junctions are vertices inside an edge of a
    neighbour, and crossings, each counted on both edges, show overlaps. A clean coverage has none.
    """
    net = _net(edge_table.selectExpr(key, *EDGE, "1 AS d"), key)
    cuts = split_points(net, key, side).selectExpr(key, "0L AS open_vertices", "bigint(NOT crossing) AS t", "bigint(crossing) AS c")
    ends = net.selectExpr(key, "inline(array(named_struct('x', x1, 'y', y1, 'd', d), named_struct('x', x2, 'y', y2, 'd', -d)))")
    balance = ends.groupBy(key, "x", "y").agg(F.sum("d").alias("d")).selectExpr(key, "bigint(d != 0) AS open_vertices", "0L AS t", "0L AS c")
    return cuts.unionByName(balance).groupBy(key).agg(
        F.sum("open_vertices").alias("open_vertices"), F.sum("t").alias("t_junctions"), F.sum("c").alias("crossings")
    )


def _doubled(links: DataFrame, value: str, ends: str) -> DataFrame:
    """Pointer doubling on (id, jump, v) until ``ends`` holds for no row of a round.

    Each round joins a row to the one it points to; ``value`` combines their values.
    """
    while True:
        far = links.selectExpr("id AS jump", "jump AS next", "v AS w")
        step = settle(
            links.join(far, "jump", "left").selectExpr("id", "next AS jump", f"{value} AS v", f"{ends} AS moved"), "doubled"
        )
        links = step.drop("moved")
        if step.filter("moved").isEmpty():
            return links


def trace(outline: DataFrame, key: str) -> DataFrame:
    """(key, ring, seq, x1, y1, x2, y2): outline edges in order along their rings.

    At a vertex a ring goes on with the first edge clockwise of where it came from, so rings that touch
    in a point stay apart. Ring and order come from pointer doubling: as many rounds of joins as the
    logarithm of the longest ring. An outline that doesn't close is an error.
    """
    edge = settle(outline.select(key, *EDGE).withColumn("id", F.monotonically_increasing_id()), "outline")
    out = edge.selectExpr(key, "x1 AS x2", "y1 AS y2", "id AS next", "x2 - x1 AS ox", "y2 - y1 AS oy")
    turn = "pmod(atan2(y1 - y2, x1 - x2) - atan2(oy, ox) - 1e-12D, 2 * pi())"
    links = settle(
        edge.join(out, [key, "x2", "y2"]).groupBy("id").agg(F.expr(f"min_by(next, {turn}) AS next")), "links"
    )
    if links.count() < edge.count():
        raise ValueError("the outline does not close; coverage_check tells where")
    smallest = _doubled(links.selectExpr("id", "next AS jump", "id AS v"), "least(v, w)", "w < v").select("id", F.col("v").alias("ring"))
    labelled = settle(links.join(smallest, "id"), "labelled")
    # Cut before the ring's smallest edge; the way left to the cut orders the ring.
    chain = labelled.selectExpr("id", "nullif(next, ring) AS jump", "if(next = ring, 0L, 1L) AS v")
    way = _doubled(chain, "v + coalesce(w, 0L)", "next IS NOT NULL").selectExpr("id", "v AS way")
    whole = labelled.filter("id = ring").join(way, "id").selectExpr("ring", "way AS last")
    seq = labelled.join(way, "id").join(whole, "ring").selectExpr("id", "ring", "last - way AS seq")
    return edge.join(seq, "id").select(key, "ring", "seq", *EDGE)


def ring_facts(rings: DataFrame, key: str) -> DataFrame:
    """(key, ring, edge_count, length_m, area_m2): holes have negative areas."""
    first = f"OVER (PARTITION BY ring)"
    local = rings.selectExpr("*", f"min(x1) {first} AS ox", f"min(y1) {first} AS oy")
    return local.groupBy(key, "ring").agg(
        F.expr("count(1) AS edge_count"),
        F.expr("sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS length_m"),
        F.expr("sum((x1 - x2) * ((y1 - oy) + (y2 - oy)) / 2) AS area_m2"),
    )


def shells(rings: DataFrame, key: str, side: float = SIDE) -> DataFrame:
    """(key, ring, shell): each ring with the shell it belongs to, a shell with itself.

    A hole belongs to the smallest shell of its key around it. One probe per hole, beside its first edge
    on the covered side, meets the shells by containment on grid buckets.
    """
    facts = settle(ring_facts(rings, key), "facts")
    outer = facts.filter("area_m2 >= 0")
    holes = facts.filter("area_m2 < 0").select("ring")
    length = "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
    probes = rings.filter("seq = 0").join(holes, "ring", "left_semi").selectExpr(
        f"{key} AS hole_key", "ring", f"(x1 + x2) / 2 - (y2 - y1) / {length} * {num(ASIDE)} AS x",
        f"(y1 + y2) / 2 + (x2 - x1) / {length} * {num(ASIDE)} AS y",
    )
    shell_edges = rings.join(outer.select("ring"), "ring", "left_semi").selectExpr("ring AS shell", *EDGE)
    around = points_in_polygons(probes, shell_edges, "shell", side).join(
        outer.selectExpr(key, "ring AS shell", "area_m2"), "shell"
    ).filter(f"{key} <=> hole_key")
    own = around.groupBy("ring").agg(F.expr(f"min_by(struct({key}, shell), struct(area_m2, shell)) AS s")).selectExpr(f"s.{key}", "ring", "s.shell")
    return outer.selectExpr(key, "ring", "ring AS shell").unionByName(own)


def outline_shapes(outline: DataFrame, key: str, side: float = SIDE, place: str = "concat(x1, ' ', y1)") -> DataFrame:
    """(key, rings, geometry): each outline as MULTIPOLYGON text, shells by size with their holes.

    ``place`` is the text of a vertex. Texts grow in pieces of ``PIECE`` vertices, then rings, then shells;
    only the finished text of one feature is one value.
    """
    rings = settle(trace(outline, key), "rings")
    belongs = shells(rings, key, side)
    pieces = rings.selectExpr("ring", f"seq div {PIECE} AS piece", "seq", f"{place} AS p").groupBy("ring", "piece").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(seq, p))), v -> v.p), ', ') AS text"), F.expr("min_by(p, seq) AS first")
    )
    texts = pieces.groupBy("ring").agg(
        F.expr("concat('(', array_join(transform(array_sort(collect_list(struct(piece, text))), v -> v.text), ', '), ', ', min_by(first, piece), ')') AS text")
    )
    parts = belongs.join(texts, "ring").groupBy(key, "shell").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(ring != shell AS hole, ring, text))), v -> v.text), ', ') AS text"),
        F.expr("count(1) AS rings"),
    )
    return parts.groupBy(key).agg(
        F.sum("rings").alias("rings"),
        F.expr("concat('MULTIPOLYGON (', array_join(transform(array_sort(collect_list(struct(shell, text))), v -> concat('(', v.text, ')')), ', '), ')') AS geometry"),
    )
