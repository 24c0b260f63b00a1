"""A filter of 16 MB over 64-bit keys that Python tasks compute: of all keys, or of those that occur twice.

Tasks send a key as four bytes under its segment, in one binary value per segment, so that nothing is
shuffled row by row. The owner of a segment works through one segment after the other. There are no
false negatives; the size is fixed, so that with more keys only more of them pass without need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keys held back by a task before they are sent on.
HELD = 4_000_000
#: A filter has 2^11 segments of 2^16 bits; what was seen once is kept in 2^21 bits a segment.
SEGMENTS, BITS, SEEN = 1 << 11, 1 << 16, 1 << 21

KeysOf = Callable[[pa.RecordBatch], np.ndarray]


def _places(keys: np.ndarray) -> list[np.ndarray]:
    """The two bits of a key in its segment."""
    return [((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64) for shift in (16, 32)]


def within(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only where a key certainly isn't in the filter."""
    base = (keys & np.uint64(SEGMENTS - 1)).astype(np.int64) << 13
    first, second = (bits[base | place >> 3] >> (place & 7).astype(np.uint8) & 1 for place in _places(keys))
    return (first & second).astype(bool)


def _thin(keys_of: KeysOf, least: int):
    """(segment, middles): bits 16 to 47 of each key once, or twice if it occurs again and ``least`` is two."""

    def sent(pending: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *pending]), return_counts=True)
        keys = np.repeat(keys, np.minimum(n, least))
        segment = (keys & np.uint64(SEGMENTS - 1)).astype(np.int32)
        order = np.argsort(segment, kind="stable")
        middles = (keys[order] >> np.uint64(16)).astype("<u4")
        own, at = np.unique(segment[order], return_index=True)
        parts = [middles[lo:hi].tobytes() for lo, hi in zip(at, [*at[1:], len(middles)])]
        return pa.record_batch([pa.array(own, pa.int32()), pa.array(parts, pa.binary())], names=["segment", "middles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for batch in batches:
            pending.append(keys_of(batch))
            size += len(pending[-1])
            if size > HELD:
                yield sent(pending)
                pending, size = [], 0
        yield sent(pending)

    return run


def _fill(least: int):
    """Bits of each segment, whose rows come in a row: for all keys, or for those that came twice."""

    def done(segment: int, filled: np.ndarray) -> pa.RecordBatch:
        packed = np.packbits(filled, bitorder="little").tobytes()
        return pa.record_batch([pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], names=["segment", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, marks, filled = None, np.zeros(SEEN >> 3, np.uint8), np.zeros(BITS, bool)
        for batch in batches:
            for segment, middles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if segment != current:
                    if current is not None:
                        yield done(current, filled)
                    current = segment
                    marks[:], filled[:] = 0, False
                values, n = np.unique(np.frombuffer(middles, "<u4"), return_counts=True)
                if least > 1:
                    place = values.astype(np.int64) & SEEN - 1
                    again = (n > 1) | (marks[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                    np.bitwise_or.at(marks, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
                    values = values[again]
                for place in _places(values.astype(np.uint64) << np.uint64(16)):
                    filled[place] = True
        if current is not None:
            yield done(current, filled)

    return run


def filter_of(rows: DataFrame, keys_of: KeysOf, least: int = 1) -> np.ndarray:
    """The filter of the keys that ``keys_of`` finds in a batch, as bytes; with ``least`` two, of those that occur twice."""
    thin = rows.mapInArrow(_thin(keys_of, least), "segment int, middles binary").repartition("segment").sortWithinPartitions("segment")
    table = thin.mapInArrow(_fill(least), "segment int, bits binary").toArrow()
    out = np.zeros((SEGMENTS, BITS >> 3), np.uint8)
    for segment, packed in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
        out[segment] = np.frombuffer(packed, np.uint8)
    return out.reshape(-1)
