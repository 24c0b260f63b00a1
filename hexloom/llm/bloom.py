"""Bloom filters as small tables: built from all rows by their owners, probed in generated code.

A filter is cut into segments of 2^16 bits. A hash picks its segment and four bits in it. Rows of the
table are (segment, words), with 1024 longs for each segment that has a bit set. The number of bits
follows the number of rows up to ``max_bits``, so what is broadcast has a fixed bound (32 MB by
default). Beyond it the filter only gets less selective: callers treat a hit as "possibly", never as
an answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_BITS = 16
MAX_BITS = 1 << 28
PER_ROW = 16


def _segments(rows: int, max_bits: int) -> int:
    """How many segments, a power of two."""
    bits = min(max(rows * PER_ROW, 1 << SEGMENT_BITS), max_bits)
    return 1 << max(0, (int(bits) - 1).bit_length() - SEGMENT_BITS)


def _locate(key: Column, segments: int) -> list[Column]:
    """Segment, and a second hash whose four 16-bit parts are the positions in it."""
    first = F.xxhash64(key)
    return [F.pmod(first, F.lit(segments)).cast("int").alias("segment"), F.xxhash64(first, F.lit(7)).alias("bits")]


def _positions(bits: np.ndarray) -> np.ndarray:
    return np.stack([(bits >> np.uint64(s)) & np.uint64(0xFFFF) for s in (0, 16, 32, 48)]).astype(np.int64)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a batch become one row with a count of at most two, before anything is shuffled."""
    for batch in batches:
        segment = batch.column(0).to_numpy(zero_copy_only=False)
        bits = batch.column(1).to_numpy(zero_copy_only=False)
        pair = np.stack([segment.astype(np.int64), bits])
        unique, counts = np.unique(pair, axis=1, return_counts=True) if len(bits) else (pair, np.zeros(0, np.int64))
        yield pa.record_batch(
            [pa.array(unique[0].astype(np.int32)), pa.array(unique[1]), pa.array(np.minimum(counts, 2).astype(np.int32))],
            names=["segment", "bits", "n"],
        )


def _fill(twice: bool):
    """Own the segments of a partition: one bitmap of what was seen, one of what was seen again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        again: dict[int, np.ndarray] = {}
        for batch in batches:
            segment = batch.column(0).to_numpy(zero_copy_only=False)
            bits = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            n = batch.column(2).to_numpy(zero_copy_only=False)
            order = np.lexsort((bits, segment))
            segment, bits, n = segment[order], bits[order], n[order]
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else []
            for lo, hi in zip(starts, [*starts[1:], len(segment)], strict=True):
                key = int(segment[lo])
                if key not in seen:
                    seen[key] = np.zeros(1 << SEGMENT_BITS, bool)
                    again[key] = np.zeros(1 << SEGMENT_BITS, bool)
                own = bits[lo:hi]
                new = np.r_[True, own[1:] != own[:-1]]
                count = np.add.reduceat(n[lo:hi], np.flatnonzero(new))
                at = _positions(own[new])
                repeated = (count > 1) | seen[key][at].all(axis=0)
                again[key][at[:, repeated]] = True
                seen[key][at] = True
        filled = again if twice else seen
        keep = [k for k, v in filled.items() if v.any()]
        packed = [np.packbits(filled[k], bitorder="little").view("<i8") for k in keep]
        yield pa.record_batch(
            [pa.array(keep, pa.int32()), pa.array(packed, pa.list_(pa.int64()))], names=["segment", "words"]
        )

    return run


def build(keys: DataFrame, key: str, rows: int, twice: bool = False, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """The filter of all values of ``key``, or of those that occur twice; and its number of segments.

    ``rows`` sizes it. Null keys take no part.
    """
    segments = _segments(rows, max_bits)
    located = keys.filter(F.col(key).isNotNull()).select(*_locate(F.col(key), segments))
    thin = located.mapInArrow(_thin, "segment int, bits long, n int")
    owned = thin.repartition("segment").mapInArrow(_fill(twice), "segment int, words array<bigint>")
    return owned, segments


def possibly(rows: DataFrame, key: str, filter_table: DataFrame, segments: int, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only where the key is certainly not in the filter."""
    names = rows.columns
    segment, bits = _locate(F.col(key), segments)
    probe = rows.select("*", segment.alias("__segment"), bits.alias("__bits"))
    table = F.broadcast(filter_table.select(F.col("segment").alias("__segment"), F.col("words").alias("__words")))

    def bit(shift: int) -> Column:
        place = f"(shiftrightunsigned(__bits, {shift}) & 65535L)"
        word = f"get(__words, cast(shiftright({place}, 6) as int))"
        return F.expr(f"shiftrightunsigned({word}, cast({place} & 63L as int)) & 1L") == 1

    hit = bit(0) & bit(16) & bit(32) & bit(48)
    return probe.join(table, "__segment", "left").select(*names, F.coalesce(hit, F.lit(False)).alias(flag))
