"""Table scans, lookups and materialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexloom.functions.projection import lonlat_to_utm33
from hexloom.sources.fixed_values import SOURCE_CATALOGUE, STAND_CODES

LOOKUP_SCHEMA = "ba_code string, deuts string, genus_latin string, notes string"


def load_table(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """Parquet scan, optionally registered as a view."""
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def load_lookup(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Code lookup with forced text columns, from a CSV file or from the built-in table."""
    if path:
        lookup = spark.read.schema(LOOKUP_SCHEMA).csv(path, header=True)
        return lookup.na.fill("", ["genus_latin"])
    return spark.createDataFrame(STAND_CODES, "ba_code string, deuts string, genus_latin string")


def source_catalogue(spark: SparkSession) -> DataFrame:
    """Known sources with geometry type, coordinate system and licence."""
    return spark.createDataFrame(
        SOURCE_CATALOGUE, "source string, geometry_type string, crs string, license string"
    )


def materialize(df: DataFrame, mode: str, name: str, path: str | None = None) -> DataFrame:
    """Keep a model as a view, as a cached frame or as a written table.

    ``view``: lazy, re-evaluated by each reader. ``cache``: kept on the executors, recomputed if one
    is lost. ``table``: written once (to ``path`` if given) and read back with real statistics.
    """
    spark = df.sparkSession
    if mode == "view":
        df.createOrReplaceTempView(name)
        return df
    if mode == "cache":
        kept = df.persist()
        kept.createOrReplaceTempView(name)
        return kept
    if mode != "table":
        raise ValueError(f"unknown mode {mode!r}")
    if path is None:
        df.write.mode("overwrite").saveAsTable(name)
        return spark.table(name)
    df.write.mode("overwrite").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.createOrReplaceTempView(name)
    return kept


def reproject(df: DataFrame, crs: str = "crs", x: str = "x", y: str = "y") -> DataFrame:
    """Bring points to EPSG:25833: rows marked EPSG:4326 are converted, all others kept."""
    others = [c for c in df.columns if c not in (x, y, crs)]
    degrees = f"coalesce({crs}, 'EPSG:25833') = 'EPSG:4326'"
    placed = df.selectExpr(
        *others,
        f"if({degrees}, {lonlat_to_utm33(x, y)}, named_struct('x', {x}, 'y', {y})) AS _p",
        f"'EPSG:25833' AS {crs}",
    )
    return placed.selectExpr(*others, f"_p.x AS {x}", f"_p.y AS {y}", crs)
