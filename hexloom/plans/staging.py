"""Staging: raw inventories to one point schema, neighbourhoods to districts and city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.numeric import safe_int
from hexloom.functions.text import label_codes, surrogate_key
from hexloom.operators.outlines import dissolve
from hexloom.operators.proximity import flag_duplicates
from hexloom.sources.fixed_values import DISTRICT_NAMES

#: Unified column -> raw column, per inventory layout; None is a column the inventory lacks.
_CADASTRE = {
    "tree_id": "id",
    "species_latin": "art_bot",
    "species_german": "art_dtsch",
    "genus_latin": "gattung",
    "genus_german": "gattung_deutsch",
    "tree_group": "art_gruppe",
}
_OPERATOR = {
    "tree_id": "id",
    "species_latin": "baumart_bo",
    "species_german": "baumart_de",
    "genus_latin": "gattung_bo",
    "genus_german": None,
    "tree_group": None,
}
LAYOUTS = {"strassenbaeume": _CADASTRE, "anlagenbaeume": _CADASTRE, "gruen_berlin": _OPERATOR}


def stage_points(raw: DataFrame, source: str) -> DataFrame:
    """Rename, trim and tag one raw inventory; rows without coordinates are dropped."""
    layout = LAYOUTS[source]
    texts = [
        f"trim(cast({c} as string)) AS {name}" if c else f"cast(NULL as string) AS {name}"
        for name, c in layout.items()
    ]
    cadastre = layout is _CADASTRE
    return raw.filter("x IS NOT NULL AND y IS NOT NULL").selectExpr(
        *texts,
        f"{safe_int('pflanzjahr') if cadastre else 'cast(NULL as int)'} AS planting_year",
        f"double({'standalter' if cadastre else 'nullif(standalter, 0)'}) AS tree_age",
        "x",
        "y",
        f"'{source}' AS source",
    )


def unify_sources(staged: dict[str, DataFrame]) -> DataFrame:
    """All staged inventories in one table with a surrogate key."""
    frames = list(staged.values())
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged.selectExpr("*", f"{surrogate_key('source', 'tree_id')} AS tree_uuid")


def unified_points(raw: dict[str, DataFrame], radius: float = 2.0) -> DataFrame:
    """Raw inventories to the unified table with the duplicate flag."""
    points = unify_sources({source: stage_points(df, source) for source, df in raw.items()})
    return flag_duplicates(points, radius=radius, id="tree_uuid")


def stage_neighbourhoods(raw: DataFrame) -> DataFrame:
    """Neighbourhood polygons with the district code from characters 7 and 8 of the key."""
    return raw.filter(F.col("rings").isNotNull()).select(
        F.col("sch").alias("ortsteil_code"),
        F.col("nam").alias("ortsteil_name"),
        F.substring("sch", 7, 2).alias("bezirk_code"),
        "rings",
    )


def district_outlines(neighbourhood_edges: DataFrame, code: str = "bezirk_code") -> DataFrame:
    """District outlines dissolved from neighbourhood edges that carry the district code."""
    return dissolve(neighbourhood_edges, code)


def district_names(codes: DataFrame, code: str = "bezirk_code") -> DataFrame:
    """District codes with their names."""
    return codes.select(code).distinct().selectExpr(
        code, f"{label_codes(code, DISTRICT_NAMES)} AS bezirk_name"
    )


def city_outline(area_edges: DataFrame) -> DataFrame:
    """One outline of all areas, keyed by a constant ``city_id``."""
    return dissolve(area_edges.withColumn("city_id", F.lit(1)), "city_id")
