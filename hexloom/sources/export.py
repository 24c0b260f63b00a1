"""Layer export: one partitioned table per map layer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.operators.tiles import tile_join
from hexloom.sources.fixed_values import LAYER_ARCHIVES


def export_layer(
    df: DataFrame, layer: str, columns: Sequence[str] | None = None, geometry: str = "geometry"
) -> DataFrame:
    """Attributes of a layer with the geometry text last; ``columns`` picks a subset."""
    names = [c for c in df.columns if c != geometry and (columns is None or c in columns)]
    return df.select(F.lit(layer).alias("layer"), *names, geometry)


def write_layers(
    layers: Sequence[DataFrame], path: str, archives: dict[str, str] | None = None
) -> None:
    """Write layers under ``archive=…/layer=…``; columns a layer lacks are NULL.

    Rows are written where they are, without a shuffle, so a layer with most of the rows is written
    by all tasks.
    """
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)
    tile_join(merged, archives or LAYER_ARCHIVES).write.mode("overwrite").partitionBy(
        "archive", "layer"
    ).parquet(path)
