"""Small geometry helpers for the tests."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POLYGONS = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("rings", T.ArrayType(T.ArrayType(POINT)))]
)

A1 = [
    [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)],
    [(1, 1), (1, 2.5), (3, 2.5), (3, 1)],
]
A2 = [[(-3, 2), (5, -4), (12, 7), (6, 3), (2, 9)]]
B1 = [[(2, 2), (9, 1), (8, 8), (5, 3.3), (1, 7)]]
B2 = [[(0, 0), (3, 0), (3, 3), (0, 3)]]
SQUARE = [[(0, 0), (1, 0), (1, 1), (0, 1)]]


def polygons(spark, **named):
    rows = [
        (name, [[(float(x), float(y)) for x, y in ring] for ring in rings])
        for name, rings in named.items()
    ]
    return spark.createDataFrame(rows, POLYGONS)


def shift(rings, dx, dy):
    return [[(x + dx, y + dy) for x, y in ring] for ring in rings]


def inside(rings, x, y):
    """Even-odd test, independent of the engine."""
    odd = False
    for ring in rings:
        for i, (x1, y1) in enumerate(ring):
            x2, y2 = ring[(i + 1) % len(ring)]
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd
