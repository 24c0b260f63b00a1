"""Operators on hexagonal cells: disks, covers, closing, boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.hexgrid import (
    SQRT3,
    disk_cells,
    disk_offsets,
    edge_length,
    hex_boundary,
    pack_cell,
)
from hexloom.functions.numeric import num
from hexloom.operators.overlay import polygon_overlap_area
from hexloom.operators.polygons import EDGE, edges, scan_spans
from hexloom.session import settle

#: Up to this many cells are broadcast with their slabs, a few megabytes.
BROADCAST_CELLS = 10_000


def hex_disk(cells: DataFrame, cell: str = "cell", k: int = 1, out: str = "neighbor") -> DataFrame:
    """Each row once per cell within ``k`` steps; a map-side explode of constant offsets."""
    return cells.selectExpr("*", f"explode({disk_cells(cell, k)}) AS {out}")


def union_cells(*cell_sets: DataFrame, cell: str = "cell") -> DataFrame:
    """Distinct cells of several sets."""
    merged = cell_sets[0].select(cell)
    for other in cell_sets[1:]:
        merged = merged.union(other.select(cell))
    return merged.distinct()


def hex_edges(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """Edge table of cells, keyed by the cell id."""
    return edges(cells.selectExpr(cell, f"array({hex_boundary(cell)}) AS rings"), cell)


def hex_cover(
    edge_table: DataFrame, key: str, res: int, mode: str = "center", side: float | None = None
) -> DataFrame:
    """(key, cell) of the cells of each polygon.

    ``center``: cells whose centre lies inside. ``center+1``: those and their neighbours.
    ``touch``: exactly the cells with a positive common area.
    Cell rows are scanned like raster lines, so work follows the outline and the cells returned.
    """
    size = edge_length(res)
    pitch = num(SQRT3 * size)
    inside = (
        scan_spans(edge_table.withColumnRenamed(key, "_key"), "_key", 1.5 * size)
        .selectExpr(
            "_key", "k", f"ceil(xa / {pitch} - k / 2D) AS a", f"ceil(xb / {pitch} - k / 2D) - 1 AS z"
        )
        .filter("a <= z")
        .selectExpr("_key", "k", "explode(sequence(a, z)) AS q")
        .selectExpr(f"_key AS {key}", f"{pack_cell(res, 'q', 'k')} AS cell")
    )
    if mode == "center":
        return inside
    if mode == "center+1":
        return hex_disk(inside, "cell", 1, "n").selectExpr(key, "n AS cell").distinct()
    if mode != "touch":
        raise ValueError(f"unknown cover mode {mode!r}")
    candidates = inside.union(_outline_cells(edge_table, key, res)).distinct()
    # Both sides stem from the polygons, so Spark can't tell the larger one; counted cells can.
    cells = settle(candidates.select("cell").distinct(), "cells")
    hint = "broadcast" if cells.count() <= BROADCAST_CELLS else "merge"
    overlap = polygon_overlap_area(
        edge_table, key, hex_edges(cells), "cell", side or max(size, 1.0), hint
    )
    return overlap.select(key, "cell")


def _outline_cells(edge_table: DataFrame, key: str, res: int) -> DataFrame:
    """Superset of the cells an outline passes, from each edge's own extent per cell row."""
    size = edge_length(res)
    a, step, pitch = num(size), num(1.5 * size), num(SQRT3 * size)

    def x_at(y: str) -> str:
        return f"if(y1 = y2, NULL, x1 + (x2 - x1) * least(greatest(({y} - y1) / (y2 - y1), 0D), 1D))"

    return (
        edge_table.selectExpr(
            f"{key} AS _key",
            *EDGE,
            f"explode(sequence(ceil((least(y1, y2) - {a}) / {step}), "
            f"floor((greatest(y1, y2) + {a}) / {step}))) AS r",
        )
        .selectExpr(
            "_key", "r", "x1", "x2", f"{x_at(f'(r * {step} - {a})')} AS u", f"{x_at(f'(r * {step} + {a})')} AS v"
        )
        .selectExpr(
            "_key",
            "r",
            f"ceil(coalesce(least(u, v), least(x1, x2)) / {pitch} - r / 2D - 0.5D) AS a",
            f"floor(coalesce(greatest(u, v), greatest(x1, x2)) / {pitch} - r / 2D + 0.5D) AS z",
        )
        .filter("a <= z")
        .selectExpr("_key", "r", "explode(sequence(a, z)) AS q")
        .selectExpr(f"_key AS {key}", f"{pack_cell(res, 'q', 'r')} AS cell")
    )


def morph_close(cells: DataFrame, k: int, cell: str = "cell") -> DataFrame:
    """Closing of a cell set: grow by ``k`` steps, then shrink by ``k``.

    Shrinking keeps a cell when every cell of its disk is in the grown set, which is a count per
    cell with map-side partial sums.
    """
    grown = hex_disk(cells.select(cell).distinct(), cell, k, "n").selectExpr(f"n AS {cell}").distinct()
    return (
        hex_disk(grown, cell, k, "n")
        .groupBy(F.col("n").alias(cell))
        .agg(F.count(F.lit(1)).alias("c"))
        .filter(f"c = {len(disk_offsets(k))}")
        .select(cell)
    )
