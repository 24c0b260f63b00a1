"""Binary geometry against hand-made bytes."""

import math
import random
import struct

import pyarrow as pa
import pytest

from hexloom.sources.binary import decode, point_binary, polygon_binary, read_geometry

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
HOLE = [(1.0, 1.0), (1.0, 2.5), (3.0, 2.0)]


def rings_bytes(rings, o):
    out = struct.pack(o + "I", len(rings))
    for ring in rings:
        closed = ring + ring[:1]
        out += struct.pack(o + "I", len(closed)) + b"".join(struct.pack(o + "dd", *p) for p in closed)
    return out


def head(kind, o, srid=None):
    code = kind | (0x20000000 if srid else 0)
    return struct.pack("B", o == "<") + struct.pack(o + "I", code) + (struct.pack(o + "I", srid) if srid else b"")


def polygon(rings, o="<", srid=None):
    return head(3, o, srid) + rings_bytes(rings, o)


def multi(parts, o="<"):
    return head(6, o) + struct.pack(o + "I", len(parts)) + b"".join(parts)


def plain(values):
    names, parts = decode(pa.array(values, pa.binary()))
    as_lists = [p and [[[(v["x"], v["y"]) for v in ring] for ring in part] for part in p] for p in parts.to_pylist()]
    return list(zip(names.to_pylist(), as_lists))


def test_hand_made_bytes():
    shift = [(x + 50, y) for x, y in SQUARE]
    got = plain([
        polygon([SQUARE, HOLE]), None, head(1, ">") + struct.pack(">dd", 1.5, -2.5),
        multi([polygon([SQUARE, HOLE]), polygon([shift], ">")], ">"), polygon([SQUARE], ">", 25833), head(3, "<") + struct.pack("<I", 0), multi([]),
    ])
    assert got == [
        ("POLYGON", [[SQUARE, HOLE]]), (None, None), ("POINT", [[[(1.5, -2.5)]]]),
        ("MULTIPOLYGON", [[SQUARE, HOLE], [shift]]), ("POLYGON", [[SQUARE]]), ("POLYGON", [[]]), ("MULTIPOLYGON", []),
    ]
    assert plain([]) == [] and plain([None]) == [(None, None)]


@pytest.mark.parametrize("cut", [1, 4, 9, 12, 20, 60, 90])
def test_truncated_bytes_fail(cut):
    whole = multi([polygon([SQUARE, HOLE])])
    with pytest.raises(ValueError, match="truncated"):
        plain([polygon([SQUARE]), whole[: len(whole) - cut]])


def test_other_faults_fail():
    for bad, why in (
        (polygon([SQUARE]) + b"x", "left behind"), (head(2, "<") + b"\0" * 8, "not read"), (b"\2" + polygon([SQUARE])[1:], "byte order"),
        (head(1003, "<") + b"\0" * 8, "two coordinates"), (multi([head(1, "<") + b"\0" * 16]), "something else"), (b"", "truncated"),
    ):
        with pytest.raises(ValueError, match=why):
            plain([bad])


def test_slices_keep_their_rows():
    values = pa.array([polygon([SQUARE]), None, polygon([HOLE]), polygon([SQUARE, HOLE])], pa.binary())
    names, parts = decode(values.slice(2))
    assert names.to_pylist() == ["POLYGON"] * 2 and [len(p[0]) for p in parts.to_pylist()] == [1, 2]


def test_round_trip_through_spark(spark):
    rng = random.Random(4)
    special = [0.0, -0.0, 1.0, -1.0, 2.0**-1022, 1e300, -1e-300, 0.1, 1 / 3, 2.0**52 + 1, math.nextafter(2.0, 0)]
    rows = [(i, rng.choice(special), rng.uniform(-6e6, 6e6)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, x double, y double").selectExpr("id", "x", "y", f"{point_binary('x', 'y')} AS geometry")
    for r in frame.collect():
        assert bytes(r["geometry"]) == head(1, ">") + struct.pack(">dd", r["x"] + 0.0, r["y"])
    read = {r["id"]: r["parts"][0][0][0] for r in read_geometry(frame).collect()}
    assert all((read[i]["x"], read[i]["y"]) == (x, y) for i, x, y in rows)
    ring = f"array({', '.join(f'struct({x}D AS x, {y}D AS y)' for x, y in SQUARE)})"
    bytes_ = spark.range(1).selectExpr(f"{polygon_binary(f'array({ring})')} AS geometry").first()["geometry"]
    assert bytes(bytes_) == polygon([SQUARE], ">")
    assert read_geometry(spark.createDataFrame([], "geometry binary")).count() == 0
