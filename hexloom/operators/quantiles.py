"""Exact quantiles of any number of rows without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.numeric import nearest_int, num, round_to
from hexloom.session import settle

DECILES = tuple(i / 10 for i in range(11))


#: Distinct values of a bucket that one task may put in order, and parts a larger one is split into.
BOUND, PARTS = 65_536, 1024


def rank_buckets(counts: DataFrame, key: str, fractions: Sequence[float], bound: int = BOUND) -> tuple[DataFrame, DataFrame]:
    """(rows, targets) for ``rank_values``: values of the buckets that hold a wanted rank, and those ranks.

    ``counts`` has (key, v, n). Rows come with ``part``, their bucket, and ``base``, the number of rows
    of the key below it. Buckets start on a scale common to all keys; one with more than ``bound``
    distinct values is split evenly between its own least and largest value, again and again, so a range
    of values however narrow never meets in one task. Each round only keeps what still has to be split.
    """
    counts = settle(counts, "counts")
    rows = counts.selectExpr(key, "v", "n", "0D AS part", "0L AS base", "floor(signum(v) * log1p(abs(v) * 16D) * 64D) AS b")
    wanted = ", ".join(num(f) for f in fractions)
    # Zero-based ranks each fraction needs: both neighbours for interpolation, one for discrete.
    ranks = (
        "array(struct('low' AS kind, floor(f * (total - 1)) AS rank), "
        "struct('high' AS kind, ceil(f * (total - 1)) AS rank), "
        "struct('disc' AS kind, greatest(ceil(f * total) - 1, 0L) AS rank))"
    )
    targets = settle(
        counts.groupBy(key).agg(F.sum("n").alias("total")).selectExpr(key, "total", f"explode(array({wanted})) AS f")
        .selectExpr(key, "total", "f", f"inline({ranks})"),
        "targets",
    )
    done: list[DataFrame] = []
    while True:
        buckets = rows.groupBy(key, "part", "base", "b").agg(
            F.sum("n").alias("bn"), F.expr("count(1) AS size"), F.min("v").alias("lo"), F.max("v").alias("hi")
        ).selectExpr("*", f"base + sum(bn) OVER (PARTITION BY {key}, part ORDER BY b ROWS UNBOUNDED PRECEDING) AS upto")
        needed = settle(
            buckets.join(targets.select(key, "rank"), key).filter("rank >= upto - bn AND rank < upto")
            .select(key, "part", "b", "size", "lo", "hi", (F.col("upto") - F.col("bn")).alias("below")).distinct(),
            "needed",
        )
        inside = rows.join(needed, [key, "part", "b"])
        done.append(inside.filter(f"size <= {bound}").selectExpr(key, "v", "n", "lo AS part", "below AS base"))
        if needed.filter(f"size > {bound}").isEmpty():
            return reduce(DataFrame.unionByName, done), targets
        rows = settle(
            inside.filter(f"size > {bound}").selectExpr(
                key, "v", "n", "lo AS part", "below AS base",
                f"cast(least({PARTS - 1}L, floor((v - lo) / (hi - lo) * {PARTS}D)) as bigint) AS b",
            ),
            "split",
        )


def rank_values(df: DataFrame, key: str, value: str, fractions: Sequence[float], bound: int = BOUND) -> DataFrame:
    """(key, fraction, cont, disc): interpolated and discrete quantiles per key, exact.

    Equal values collapse to counts first, and only buckets with a wanted rank are ordered, see
    ``rank_buckets``; a key with all the rows spreads over its buckets. NULL and NaN take no part.
    """
    counts = (
        df.filter(f"{value} IS NOT NULL AND NOT isnan({value})")
        .groupBy(key, F.expr(f"cast({value} as double) AS v"))
        .agg(F.expr("count(1) AS n"))
    )
    rows, targets = rank_buckets(counts, key, fractions, bound)
    fine = rows.selectExpr("*", f"base + sum(n) OVER (PARTITION BY {key}, part ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto")
    picked = (
        fine.join(targets, key)
        .filter("rank >= upto - n AND rank < upto")
        .groupBy(key, "f")
        .agg(
            *[F.expr(f"max(CASE WHEN kind = '{k}' THEN v END) AS {k}") for k in ("low", "high", "disc")],
            F.expr("max(total) AS total"),
        )
    )
    part = "(f * (total - 1) - floor(f * (total - 1)))"
    return picked.selectExpr(
        key, "f AS fraction", f"if(low = high, low, low + (high - low) * {part}) AS cont", "disc"
    )


def density_quantiles(
    marts: DataFrame,
    key: str = "level",
    value: str = "tree_density_km2",
    cover: str = "forest_cover_pct",
    max_cover: float = 85.0,
) -> DataFrame:
    """(key, p50, p95, quantiles): discrete median and p95 as int, deciles as array.

    Several levels go through in one pass; rows dominated by forest stay out.
    """
    usable = marts.filter(f"{cover} <= {num(max_cover)}")
    return rank_values(usable, key, value, sorted({*DECILES, 0.95})).groupBy(key).agg(
        F.expr(f"{nearest_int('max(CASE WHEN fraction = 0.5D THEN disc END)')} AS p50"),
        F.expr(f"{nearest_int('max(CASE WHEN fraction = 0.95D THEN disc END)')} AS p95"),
        # Eleven entries at most. Densities carry one decimal, so six drop only binary noise.
        F.expr(
            "transform(array_sort(collect_list(CASE WHEN fraction != 0.95D "
            f"THEN struct(fraction, cont) END)), d -> {round_to('d.cont', 6)}) AS quantiles"
        ),
    )
