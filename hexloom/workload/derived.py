"""Spatial inputs that Spark derives from the driver tables.

The definitions are plain SQL shared with the oracle; integer arithmetic up to one final division
keeps every value equal in both engines. Remainders are taken before squaring, so keys of any size
stay inside 64 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_U = """
SELECT CAST(o_orderkey AS STRING) AS tree_id, o_orderstatus AS source,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey % 25 AS STRING) END AS genus_latin,
  380000 + (((o_orderkey % 1000000) * (o_orderkey % 1000000) * 31 + o_custkey * 7919) % 1000000)
    / CAST(1000 AS DOUBLE) AS x,
  5810000 + (((o_orderkey % 1000000) * (o_orderkey % 1000000) * 17 + o_custkey * 15485863) % 1000000)
    / CAST(1000 AS DOUBLE) AS y
FROM {orders}
"""

POINTS_D = """
SELECT l_returnflag AS source,
  CASE WHEN l_discount = 0.1 THEN 'unbekannt' WHEN l_tax = 0.0 THEN NULL
       ELSE ' ' || p_brand END AS genus_latin,
  p_name AS species_latin,
  380000 + (((l_orderkey % 4000000) * (l_orderkey % 4000000) * 31 + l_partkey * 7919
    + l_linenumber * 104729) % 4000000) / CAST(1000 AS DOUBLE) AS x,
  5810000 + (((l_orderkey % 4000000) * (l_orderkey % 4000000) * 17 + l_suppkey * 15485863
    + l_linenumber * 32452843) % 4000000) / CAST(1000 AS DOUBLE) AS y
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

AREAS = """
SELECT n_nationkey AS area_id, n_name AS area_name, n_regionkey AS group_id,
  '110000' || lpad(CAST(n_regionkey + 1 AS STRING), 2, '0')
    || lpad(CAST(n_nationkey AS STRING), 4, '0') AS sch,
  CAST(380000 + 800 * (n_nationkey % 5) AS DOUBLE) AS x0,
  CAST(5810000 + 800 * floor(n_nationkey / 5) AS DOUBLE) AS y0
FROM {nation}
"""

STANDS = """
SELECT p_partkey AS stand_id, p_brand, p_size,
  CAST(380000 + (p_partkey * 7919) % 3900 AS DOUBLE) AS ax,
  CAST(5810000 + ((p_partkey % 3900) * (p_partkey % 3900) * 17 + p_partkey * 104729) % 3900 AS DOUBLE) AS ay,
  CAST(2 * p_size + 2 AS DOUBLE) AS s,
  ' ' || p_brand AS ba1, 60 AS m1,
  'Brand#' || CAST(p_size % 25 + 1 AS STRING) AS ba2, 30 AS m2,
  'Brand#' || CAST(p_partkey % 25 + 1 AS STRING) AS ba3, p_size % 2 * 10 AS m3,
  CAST(NULL AS STRING) AS ba4, 10 AS m4, 'UNKNOWN' AS ba5, 5 AS m5
FROM {part}
"""

LOOKUP = """
SELECT DISTINCT p_brand AS ba_code,
  CASE WHEN TRY_CAST(substring(p_brand, 7, 4) AS INT) IN (3, 9) THEN ''
       ELSE 'G' || CAST(TRY_CAST(substring(p_brand, 7, 4) AS INT) % 7 AS STRING) END AS genus_latin
FROM {part}
"""

PLOTS = """
SELECT p_partkey AS plot_id, p_size % 5 AS group_id, CAST((p_partkey - 1) % 40 AS BIGINT) AS col,
  CAST(floor((p_partkey - 1) / 40) AS BIGINT) AS row
FROM {part}
"""

RAW_POINTS = """
SELECT ' ' || CAST(o_orderkey AS STRING) || ' ' AS id, o_orderstatus,
  o_orderpriority || ' ''Cultivar''' AS art_bot, ' ' || o_orderpriority AS art_dtsch,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ' G' || CAST(o_custkey % 25 AS STRING) || ' ' END AS gattung,
  'de' AS gattung_deutsch, 'group ' AS art_gruppe,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(1900 + o_custkey % 120 AS STRING) || '.6'
       WHEN o_orderkey % 5 = 1 THEN ' ' || CAST(1900 + o_custkey % 120 AS STRING) || ' '
       WHEN o_orderkey % 5 = 2 THEN 'n/a' WHEN o_orderkey % 5 = 3 THEN ''
       ELSE CAST(1900 + o_custkey % 120 AS STRING) END AS pflanzjahr,
  CAST(o_custkey % 60 AS DOUBLE) AS standalter,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE
  380000 + (((o_orderkey % 1000000) * (o_orderkey % 1000000) * 31 + o_custkey * 7919) % 1000000)
    / CAST(1000 AS DOUBLE) END AS x,
  5810000 + (((o_orderkey % 1000000) * (o_orderkey % 1000000) * 17 + o_custkey * 15485863) % 1000000)
    / CAST(1000 AS DOUBLE) AS y
FROM {orders}
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _derive(spark: SparkSession, sf: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf, n) for n in names})


def points_u(spark: SparkSession, sf: str) -> DataFrame:
    """Points with a unique id on one square kilometre."""
    return _derive(spark, sf, POINTS_U, "orders")


def points_d(spark: SparkSession, sf: str) -> DataFrame:
    """Dense points without an id on sixteen square kilometres."""
    return _derive(spark, sf, POINTS_D, "lineitem", "part")


def raw_inventories(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Three raw inventories in their own column layouts."""
    raw = _derive(spark, sf, RAW_POINTS, "orders")
    operator = raw.filter("o_orderstatus = 'P'").select(
        "id",
        F.col("art_bot").alias("baumart_bo"),
        F.col("art_dtsch").alias("baumart_de"),
        F.col("gattung").alias("gattung_bo"),
        "standalter",
        "x",
        "y",
    )
    return {
        "strassenbaeume": raw.filter("o_orderstatus = 'F'"),
        "anlagenbaeume": raw.filter("o_orderstatus = 'O'"),
        "gruen_berlin": operator,
    }


def _corner(x: str, y: str) -> str:
    return f"struct({x} AS x, {y} AS y)"


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty-five squares as polygons."""
    ring = ", ".join(
        _corner(x, y)
        for x, y in (("x0", "y0"), ("x0 + 800", "y0"), ("x0 + 800", "y0 + 800"), ("x0", "y0 + 800"))
    )
    return _derive(spark, sf, AREAS, "nation").withColumn("rings", F.expr(f"array(array({ring}))"))


def stands(spark: SparkSession, sf: str) -> DataFrame:
    """L-shaped stands as polygons with five code slots."""
    ring = ", ".join(
        _corner(f"ax + {x} * s", f"ay + {y} * s")
        for x, y in ((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))
    )
    return _derive(spark, sf, STANDS, "part").withColumn("rings", F.expr(f"array(array({ring}))"))


def lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Stand code to genus."""
    return _derive(spark, sf, LOOKUP, "part")


def plots(spark: SparkSession, sf: str, width: int = 100) -> DataFrame:
    """Slanted plots of random groups in rows; odd ones come in two halves, some others have a hole.

    A half's corners lie in the middle of a whole neighbour's side. Plots wider than 100 overlap the
    next one of their row.
    """

    def at(u: float, v: float) -> str:
        return _corner(f"380000D + 100 * col + 50 * row + {u + 0.5 * v!r}D", f"5810000D + 100 * row + {v}")

    def ring(*corners: tuple[float, float]) -> str:
        return f"array({', '.join(at(u, v) for u, v in corners)})"

    box = lambda low, high: ring((0, low), (width, low), (width, high), (0, high))
    hole = ring((40, 40), (60, 40), (40, 70))
    parts = (
        f"CASE WHEN plot_id % 2 = 1 THEN array(array({box(0, 50)}), array({box(50, 100)})) "
        f"WHEN plot_id % 14 = 0 THEN array(array({box(0, 100)}, {hole})) ELSE array(array({box(0, 100)})) END"
    )
    return _derive(spark, sf, PLOTS, "part").selectExpr("group_id", f"posexplode({parts}) AS (part, rings)", "plot_id").selectExpr(
        "concat(plot_id, '-', part) AS plot_id", "group_id", "rings"
    )
