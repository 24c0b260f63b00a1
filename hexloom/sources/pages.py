"""Landed feature pages (GeoJSON) to flat rows, as a batch or as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def page_schema(properties: str, geometry_type: str = "Point") -> T.StructType:
    """Schema of one page; coordinates nest as deep as the geometry type needs."""
    depth = {"Point": 1, "Polygon": 3, "MultiPolygon": 4}[geometry_type]
    coordinates = "array<" * depth + "double" + ">" * depth
    return T.StructType.fromDDL(
        "type string, features array<struct<type string, "
        f"geometry struct<type string, coordinates {coordinates}>, "
        f"properties struct<{properties}>>>"
    )


def _flatten(pages: DataFrame, geometry_type: str) -> DataFrame:
    feature = pages.select(F.explode("features").alias("f"))
    place = F.col("f.geometry.coordinates")
    if geometry_type == "Point":
        geometry = [F.get(place, F.lit(0)).alias("x"), F.get(place, F.lit(1)).alias("y")]
    else:

        def to_rings(rings):
            return F.transform(
                rings,
                lambda ring: F.transform(
                    ring,
                    lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")),
                ),
            )

        geometry = [
            to_rings(place).alias("rings")
            if geometry_type == "Polygon"
            else F.transform(place, to_rings).alias("parts")
        ]
    return feature.select("f.properties.*", F.col("f.geometry.type").alias("geom_type"), *geometry)


def ingest_feature_pages(
    spark: SparkSession,
    path: str,
    properties: str,
    geometry_type: str = "Point",
    stream: bool = False,
    lines: bool = False,
) -> DataFrame:
    """Rows of all landed pages.

    A page file holds one document, which is one parse unit; with ``lines`` a file holds one page
    per line and can be split. With ``stream`` the folder is a file stream: see
    ``streaming.landing`` for the resumable run. A page that can't be read fails the run; none is skipped.
    """
    reader = spark.readStream if stream else spark.read
    pages = reader.schema(page_schema(properties, geometry_type)).option("multiLine", not lines).option("mode", "FAILFAST")
    return _flatten(pages.json(path), geometry_type)
