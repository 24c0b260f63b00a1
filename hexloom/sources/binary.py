"""Binary geometry at the edge of the system: well-known binary in and out of rings.

The reader works on whole Arrow buffers: all values of a batch are one byte array, and each step of the
format (header, number of rings, number of points, points) is one gather over all geometries that are at
that step. Nothing loops over points, and a batch of a million points costs a few dozen array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: codes of the types that are read.
POINT, POLYGON, MULTIPOLYGON = 1, 3, 6
_NAMES = {POINT: "POINT", POLYGON: "POLYGON", MULTIPOLYGON: "MULTIPOLYGON"}
#: Bits of a type code that say that coordinates or a reference system are added.
_EXTRA = 0xE0000000
_RINGS = "array<array<struct<x: double, y: double>>>"


class _Cursor:
    """Positions in the buffer of a batch, one for each geometry or part that is being read."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray):
        self.data, self.at, self.end = data, at, end

    def take(self, size: int) -> np.ndarray:
        """The next ``size`` bytes of each, as rows."""
        if (self.at + size > self.end).any():
            raise ValueError("truncated binary geometry")
        out = self.data[self.at[:, None] + np.arange(size)]
        self.at = self.at + size
        return out

    def number(self, little: np.ndarray) -> np.ndarray:
        raw = self.take(4)
        return np.where(little, raw.copy().view("<u4").ravel(), raw.copy().view(">u4").ravel()).astype(np.int64)

    def header(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte order and type; a reference system is skipped, more than two coordinates are an error."""
        order = self.take(1).ravel()
        if (order > 1).any():
            raise ValueError("unknown byte order in binary geometry")
        little = order == 1
        kind = self.number(little)
        known = (kind & 0x20000000) > 0
        if ((kind & 0xC0000000) > 0).any() or ((kind & ~np.int64(_EXTRA)) > 1000).any():
            raise ValueError("binary geometry with more than two coordinates")
        if known.any():
            skipped = _Cursor(self.data, self.at[known], self.end[known])
            skipped.take(4)
            self.at = self.at.copy()
            self.at[known] = skipped.at
        return little, kind & ~np.int64(_EXTRA)


def _polygons(cursor: _Cursor, little: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rings of each polygon, points of each ring, x and y of each point); the cursor ends behind them.

    Rings are read in rounds, the first of every polygon, then the second, ...: as many rounds as the
    polygon with the most rings has.
    """
    rings = cursor.number(little)
    if (rings * 4 > cursor.end - cursor.at).any():
        raise ValueError("truncated binary geometry")
    first = np.cumsum(rings) - rings
    sizes, starts, orders = np.zeros(rings.sum(), np.int64), np.zeros(rings.sum(), np.int64), np.repeat(little, rings)
    for r in range(int(rings.max(initial=0))):
        open_ = np.flatnonzero(rings > r)
        step = _Cursor(cursor.data, cursor.at[open_], cursor.end[open_])
        points = step.number(little[open_])
        sizes[first[open_] + r], starts[first[open_] + r] = points, step.at
        if (step.at + 16 * points > step.end).any():
            raise ValueError("truncated binary geometry")
        cursor.at[open_] = step.at + 16 * points
    before = np.cumsum(sizes) - sizes
    place = np.repeat(starts, sizes) + 16 * (np.arange(sizes.sum()) - np.repeat(before, sizes))
    raw = cursor.data[place[:, None] + np.arange(16)] if len(place) else np.zeros((0, 16), np.uint8)
    xy = np.where(np.repeat(orders, sizes)[:, None], raw.view("<f8").reshape(-1, 2), raw.view(">f8").reshape(-1, 2)).astype("f8")
    return rings, sizes, xy


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def decode(values: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(type name, parts) of binary geometries: parts are polygons, each a list of open rings of (x, y)."""
    values = values.cast(pa.large_binary())
    here = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    bounds = np.frombuffer(values.buffers()[1], "<i8")[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    cursor = _Cursor(data, bounds[:-1][here].copy(), bounds[1:][here])
    little, kind = cursor.header()
    if not np.isin(kind, [*_NAMES]).all():
        raise ValueError("binary geometry of a type that is not read")
    # Parts of all geometries: a multipolygon has many, a polygon one, a point one ring of one point.
    count = np.ones(len(here), np.int64)
    several = kind == MULTIPOLYGON
    multi = _Cursor(data, cursor.at[several], cursor.end[several])
    count[several] = multi.number(little[several])
    cursor.at[several] = multi.at
    if (count * 9 > np.where(several, cursor.end - cursor.at, 9 * count)).any():
        raise ValueError("truncated binary geometry")
    first = np.cumsum(count) - count
    part_rings: list[np.ndarray] = [np.zeros(0, np.int64)] * int(count.sum())
    part_points: list[np.ndarray] = list(part_rings)
    part_xy: list[np.ndarray] = [np.zeros((0, 2))] * len(part_rings)

    def keep(slots: np.ndarray, rings: np.ndarray, sizes: np.ndarray, xy: np.ndarray) -> None:
        ring_ends, point_ends = np.cumsum(rings), np.cumsum(sizes)
        for slot, low, high in zip(slots.tolist(), (ring_ends - rings).tolist(), ring_ends.tolist()):
            part_points[slot] = sizes[low:high]
            part_xy[slot] = xy[(point_ends[low] - sizes[low] if high > low else 0) : (point_ends[high - 1] if high > low else 0)]

    for r in range(int(count.max(initial=0))):
        open_ = np.flatnonzero((count > r) & (kind != POINT))
        step = _Cursor(data, cursor.at[open_], cursor.end[open_])
        order, inner = little[open_].copy(), several[open_]
        if inner.any():
            inside = _Cursor(data, step.at[inner], step.end[inner])
            order[inner], kinds = inside.header()
            if (kinds != POLYGON).any():
                raise ValueError("a multipolygon holds something else than polygons")
            step.at = step.at.copy()
            step.at[inner] = inside.at
        rings, sizes, xy = _polygons(step, order)
        keep(first[open_] + r, rings, sizes, xy)
        cursor.at[open_] = step.at
    points = np.flatnonzero(kind == POINT)
    if len(points):
        step = _Cursor(data, cursor.at[points], cursor.end[points])
        raw = step.take(16)
        xy = np.where(little[points][:, None], raw.copy().view("<f8"), raw.copy().view(">f8")).astype("f8")
        keep(first[points], np.ones(len(points), np.int64), np.ones(len(points), np.int64), xy)
        cursor.at[points] = step.at
    if (cursor.at != cursor.end).any():
        raise ValueError("bytes left behind a binary geometry")

    xy = np.concatenate(part_xy) if part_xy else np.zeros((0, 2))
    sizes = np.concatenate(part_points) if part_points else np.zeros(0, np.int64)
    # The format repeats a ring's first point at its end; rings here stay open.
    ends = np.cumsum(sizes)
    full = np.flatnonzero(sizes > 1)
    closed = full[(xy[ends[full] - 1] == xy[ends[full] - sizes[full]]).all(axis=1)]
    keep_point = np.ones(len(xy), bool)
    keep_point[ends[closed] - 1] = False
    sizes = sizes.copy()
    sizes[closed] -= 1
    struct = pa.StructArray.from_arrays([pa.array(xy[keep_point, 0]), pa.array(xy[keep_point, 1])], ["x", "y"])
    rings = pa.ListArray.from_arrays(_offsets(sizes), struct)
    parts = pa.ListArray.from_arrays(_offsets(np.array([len(p) for p in part_points], np.int64)), rings)
    per_row = np.zeros(len(values), np.int64)
    per_row[here] = count
    names = np.full(len(values), None, object)
    names[here] = [_NAMES[k] for k in kind.tolist()]
    missing = np.ones(len(values), bool)
    missing[here] = False
    listed = pa.ListArray.from_arrays(_offsets(per_row), parts, mask=pa.array(missing))
    return pa.array(names, pa.string()), listed


def read_geometry(df: DataFrame, column: str = "geometry") -> DataFrame:
    """``df`` with ``geom_type`` and ``parts`` (polygons as lists of rings) in place of a binary column.

    Points are one part of one ring of one point. Nulls stay null; anything that isn't two-dimensional
    points, polygons or multipolygons, or ends too early, fails the run.
    """
    rest = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = decode(batch.column(len(rest)))
            yield pa.record_batch([*batch.columns[:-1], names, parts], names=[*rest, "geom_type", "parts"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column)
    schema = f"{kept}, geom_type string, parts array<{_RINGS}>" if rest else f"geom_type string, parts array<{_RINGS}>"
    return df.select(*rest, F.col(column)).mapInArrow(run, schema)


def _hex_double(value: str) -> str:
    """The eight bytes of a double in hex, most significant first; arithmetic on its parts, in generated code."""
    size = f"abs({value})"
    power = f"greatest(floor(log2({size})), -1022)"
    low = f"if({size} / pow(2D, {power}) < 1, {power} - 1, if({size} / pow(2D, {power}) >= 2, {power} + 1, {power}))"
    bits = f"if({size} = 0, 0L, bigint(({low}) + 1023) * 4503599627370496L + bigint(({size} / pow(2D, {low}) - 1) * 4503599627370496D))"
    return f"lpad(hex({bits} | if({value} < 0, -9223372036854775807L - 1L, 0L)), 16, '0')"


def point_binary(x: str, y: str) -> str:
    """SQL text: a point as big-endian well-known binary."""
    return f"unhex(concat('0000000001', {_hex_double(x)}, {_hex_double(y)}))"


def polygon_binary(rings: str) -> str:
    """SQL text: open rings, the outer one first, as a big-endian polygon."""
    number = lambda n: f"lpad(hex({n}), 8, '0')"
    vertex = f"concat({_hex_double('p.x')}, {_hex_double('p.y')})"
    ring = f"concat({number('size(r) + 1')}, array_join(transform(concat(r, slice(r, 1, 1)), p -> {vertex}), ''))"
    return f"unhex(concat('0000000003', {number(f'size({rings})')}, array_join(transform({rings}, r -> {ring}), '')))"
