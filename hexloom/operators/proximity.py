"""Cross-source near-duplicates: points of different sources within a radius that agree in genus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.numeric import num

# Key texts no trimmed category can have.
_NULL_KEY = " null "
_ANY_KEY = " any "


def _sites(points: DataFrame, x: str, y: str, source: str, category: str) -> DataFrame:
    """Distinct (place, source, category): copies of a point collapse before any pairing."""
    return (
        points.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL AND {source} IS NOT NULL")
        .selectExpr(
            f"{x} AS _x", f"{y} AS _y", f"{source} AS _source", f"lower(trim({category})) AS _cat"
        )
        .distinct()
    )


def _near_cells(x: str, y: str, side: float, radius: float) -> str:
    """Grid cells a point must be known in: its own and those within ``radius`` of it."""

    def reach(c: str) -> str:
        return f"sequence(floor(({c} - {num(radius)}) / {num(side)}), floor(({c} + {num(radius)}) / {num(side)}))"

    return (
        f"flatten(transform({reach(x)}, a -> "
        f"transform({reach(y)}, b -> named_struct('cx', a, 'cy', b))))"
    )


def duplicate_sites(
    points: DataFrame, x: str, y: str, source: str, category: str, radius: float = 2.0
) -> DataFrame:
    """Sites with a partner of another source within ``radius`` and an equal or missing category.

    Shape of the job:

    * copies collapse to sites first, so one heavily repeated place costs one row per source and
      category;
    * candidates meet on (grid cell, category key) with cells four radii wide; a site is repeated
      into a neighbouring cell only when it lies within the radius of it (2.25 copies on average);
    * a first pass uses cells so small that all their sites are partners of each other: there the
      least and the largest source of an agreeing category decide without a pair, however many sites
      a cell holds;
    * for the other sites, groups that hold a single source are dropped by a min/max aggregate before
      any pair is looked at, so a dense place known to one source only costs nothing;
    * the rest is a semi join, which stops at the first partner and emits no pairs; hot cells are
      split by adaptive skew handling on the probing side.
    """
    side = 4.0 * radius
    all_sites = _sites(points, x, y, source, category)
    crowded = _crowded(all_sites, radius)
    same = F.expr("a._x = c._x AND a._y = c._y AND a._source = c._source AND a._cat <=> c._cat")
    sites = all_sites.alias("a").join(crowded.alias("c"), same, "left_anti")

    # A site with a category meets equal categories and missing ones; one without meets anything.
    probes = sites.selectExpr(
        "*",
        # Declared non-null, so that no null test sinks into the scan and sites are built once.
        f"coalesce(floor(_x / {num(side)}), 0L) AS cx",
        f"coalesce(floor(_y / {num(side)}), 0L) AS cy",
        f"explode(if(_cat IS NULL, array('{_ANY_KEY}'), array(_cat, '{_NULL_KEY}'))) AS _key",
    )
    offers = all_sites.selectExpr(
        "_x AS _ox",
        "_y AS _oy",
        "_source AS _osource",
        f"explode(array(coalesce(_cat, '{_NULL_KEY}'), '{_ANY_KEY}')) AS _key",
    )
    offers = offers.selectExpr("*", f"inline({_near_cells('_ox', '_oy', side, radius)})")

    sources = offers.groupBy("cx", "cy", "_key").agg(
        F.min("_osource").alias("_lo"), F.max("_osource").alias("_hi")
    )
    # A semi join, because an inner one would be reordered behind the pair test.
    several = F.expr(
        "p.cx = s.cx AND p.cy = s.cy AND p._key = s._key AND (s._lo != p._source OR s._hi != p._source)"
    )
    hopeful = probes.alias("p").join(sources.alias("s"), several, "left_semi")
    match = F.expr(
        "p.cx = o.cx AND p.cy = o.cy AND p._key = o._key AND p._source != o._osource AND "
        f"sqrt((p._x - o._ox) * (p._x - o._ox) + (p._y - o._oy) * (p._y - o._oy)) <= {num(radius)}"
    )
    return (
        hopeful.alias("p")
        .join(offers.alias("o"), match, "left_semi")
        .select("_x", "_y", "_source", "_cat")
        .unionByName(crowded)
        .distinct()
    )


def _crowded(sites: DataFrame, radius: float) -> DataFrame:
    """Sites that share a cell of diagonal ``radius`` with an agreeing site of another source."""
    small = num(radius / 2**0.5 * (1 - 1e-6))
    placed = sites.selectExpr("*", f"floor(_x / {small}) AS sx", f"floor(_y / {small}) AS sy")
    offered = placed.selectExpr("sx", "sy", "_source", f"explode(array(coalesce(_cat, '{_NULL_KEY}'), '{_ANY_KEY}')) AS _key")
    sources = offered.groupBy("sx", "sy", "_key").agg(F.min("_source").alias("_lo"), F.max("_source").alias("_hi"))
    asking = placed.selectExpr("*", f"explode(if(_cat IS NULL, array('{_ANY_KEY}'), array(_cat, '{_NULL_KEY}'))) AS _key")
    several = F.expr("p.sx = s.sx AND p.sy = s.sy AND p._key = s._key AND (s._lo != p._source OR s._hi != p._source)")
    return asking.alias("p").join(sources.alias("s"), several, "left_semi").select("_x", "_y", "_source", "_cat").distinct()


def flag_duplicates(
    points: DataFrame,
    x: str = "x",
    y: str = "y",
    source: str = "source",
    category: str = "genus_latin",
    radius: float = 2.0,
    flag: str = "is_potential_duplicate",
    id: str | None = None,
) -> DataFrame:
    """All points plus a boolean; duplicates are marked, never removed.

    With ``id`` the flag goes by key: every row whose id belongs to a duplicate carries it, wherever it
    lies, and rows without an id never do, though they may be the partners of others.
    """
    if id is not None:
        hits = proximity_duplicates(points, id, x, y, source, category, radius).filter(F.col(id).isNotNull())
        marked = points.join(hits.select(F.col(id).alias("_hit")), F.col(id) == F.col("_hit"), "left")
        return marked.select(*[points[c] for c in points.columns], F.col("_hit").isNotNull().alias(flag))
    found = duplicate_sites(points, x, y, source, category, radius).withColumn("_hit", F.lit(True))
    same = (
        (F.col(x) == F.col("_x"))
        & (F.col(y) == F.col("_y"))
        & (F.col(source) == F.col("_source"))
        & F.lower(F.trim(F.col(category))).eqNullSafe(F.col("_cat"))
    )
    columns = [F.col(c) for c in points.columns]
    return points.join(found, same, "left").select(
        *columns, F.coalesce("_hit", F.lit(False)).alias(flag)
    )


def proximity_duplicates(
    points: DataFrame,
    id: str,
    x: str = "x",
    y: str = "y",
    source: str = "source",
    category: str = "genus_latin",
    radius: float = 2.0,
) -> DataFrame:
    """Distinct ids of the potential duplicates."""
    flagged = flag_duplicates(points, x, y, source, category, radius, "_dup")
    return flagged.filter("_dup").select(id).distinct()
