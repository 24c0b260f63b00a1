"""Resumable ingest of landed pages, running counts over arriving points, and counts kept in a table.

Kept counts: every micro-batch adds one small table of its own under ``deltas/batch=<id>``. A batch that
runs again after a failure overwrites the same folder, so nothing is counted twice. ``fold_counts`` sums
what has gathered into ``base/upto=<id>``; readers take the newest complete base and the deltas after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hexloom.sources.pages import ingest_feature_pages


def land_pages(
    spark: SparkSession,
    pages: str,
    table: str,
    checkpoint: str,
    properties: str,
    geometry_type: str = "Point",
    lines: bool = False,
) -> StreamingQuery:
    """Append all pages not yet read to ``table`` and stop.

    The checkpoint remembers finished files, so a run after a failure continues where it ended and a
    run without new files does nothing.
    """
    rows = ingest_feature_pages(spark, pages, properties, geometry_type, True, lines)
    return (
        rows.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counts(points: DataFrame, key: str, keys: Sequence[str]) -> DataFrame:
    """Counts per group over a stream of points, each ``key`` counted once.

    The sources carry no event time, so there is no watermark and the state holds every distinct
    key. Use ``update`` output.
    """
    return points.dropDuplicates([key]).groupBy(*keys).agg(F.count(F.lit(1)).alias("tree_count"))


def keep_counts(points: DataFrame, key: str, keys: Sequence[str], table: str, checkpoint: str) -> StreamingQuery:
    """Add the counts of all points not yet read to the counts in ``table`` and stop.

    Each ``key`` counts once, in the batch that brings it first, as in ``running_counts``: repeated
    deliveries of an inventory add nothing, and rows without a key count as one. Work and shuffle follow
    the new rows; the state holds every distinct key.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("tree_count"))
        counts.write.mode("overwrite").parquet(f"{table}/deltas/batch={batch_id}")

    return (
        points.dropDuplicates([key])
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(add)
        .start()
    )


def _complete(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Ids of the parts ``name=<id>`` of a folder that were written to their end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def _counted_parts(spark: SparkSession, table: str) -> tuple[list[str], int]:
    """Folders whose sum is the counts so far, and the last batch among them (-1 if none)."""
    bases, deltas = _complete(spark, f"{table}/base", "upto"), _complete(spark, f"{table}/deltas", "batch")
    upto = bases[-1] if bases else -1
    later = [d for d in deltas if d > upto]
    folders = [f"{table}/base/upto={upto}"] if bases else []
    return folders + [f"{table}/deltas/batch={d}" for d in later], max([upto, *later])


def kept_counts(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """(keys, tree_count) of all batches in ``table``; fails if it holds none."""
    folders, _ = _counted_parts(spark, table)
    if not folders:
        raise ValueError(f"no counts in {table}")
    return spark.read.parquet(*folders).groupBy(*keys).agg(F.sum("tree_count").alias("tree_count"))


def fold_counts(spark: SparkSession, table: str, keys: Sequence[str]) -> None:
    """Sum base and deltas into a new base; a run that breaks off leaves the earlier parts in force."""
    folders, upto = _counted_parts(spark, table)
    if len(folders) > 1:
        kept_counts(spark, table, keys).write.mode("overwrite").parquet(f"{table}/base/upto={upto}")
