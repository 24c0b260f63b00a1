"""Vectors as columns of integers: usable rows, scaled components, blocks of rows laid out by dimension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a block, and so the unit of memory: 8 MB of 64 dimensions.
BLOCK = 32_768


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds neither null nor non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(vector).isNotNull() & ~odd)


def scaled(vector: str, factor: int) -> str:
    """SQL text: every component as floor(factor * x), computed in double precision."""
    return f"transform({vector}, x -> floor({factor} * double(x)))"


def arrived(batches: Iterator[pa.RecordBatch], finish: Callable[[list[np.ndarray], np.ndarray], Iterator], size: int) -> Iterator:
    """Gather rows into blocks of ``size`` vectors of one length and hand them to ``finish``.

    A batch holds int64 columns and, as the last one, the components as a list. ``finish`` gets the
    columns and a matrix of int64, one row per vector.
    """
    waiting: dict[int, list] = {}

    def flush(width: int):
        parts = waiting.pop(width)
        heads = [np.concatenate(p) for p in zip(*(h for h, _ in parts), strict=True)]
        return finish(heads, np.concatenate([m for _, m in parts]))

    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        heads = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
        for width in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == width)
            values = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            for at in range(0, len(rows), size):
                few = rows[at : at + size]
                part = values[at * width : (at + len(few)) * width].reshape(len(few), width)
                waiting.setdefault(width, []).append(([h[few] for h in heads], part))
                if sum(len(m) for _, m in waiting[width]) >= size:
                    yield from flush(width)
    for width in list(waiting):
        yield from flush(width)


def bounded(matrix: np.ndarray, limit: int, what: str) -> None:
    """Sums of products of larger values would not fit 64 bits; say so instead of wrapping around."""
    if matrix.size and int(max(matrix.max(), -matrix.min())) > limit:
        raise ValueError(f"a scaled component beyond {limit} makes {what} leave 64 bits")
