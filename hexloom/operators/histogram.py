"""Top-k histograms, dominant values and mixes per key.

Every operator starts from counts per (key, value): a partial aggregate on the map side and a shuffle
on key *and* value, so a key holding a third of all rows is spread over its values. Only these small
counts are then grouped by the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.numeric import percent, ratio, round_to
from hexloom.session import settle

_ONE = "_one"


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key when none is given, so one code path serves single-row summaries."""
    return (df, list(keys)) if keys else (df.withColumn(_ONE, F.lit(1)), [_ONE])


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """Best ``k`` rows per key with their rank ``rn``; ``order`` is an ORDER BY list.

    The rank filter sits right on the window, so Spark trims each map task to ``k`` rows per key
    before the shuffle. Without keys the same is a sorted limit, and the rank is taken over k rows.
    """
    if not keys or list(keys) == [_ONE]:
        best = df.orderBy(*[F.expr(o[:-5]).desc() if o.endswith(" DESC") else F.expr(o) for o in order.split(", ")])
        return best.limit(k).selectExpr("*", f"row_number() OVER (ORDER BY {order}) AS rn")
    window = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})"
    return df.selectExpr("*", f"row_number() {window} AS rn").filter(f"rn <= {k}")


def _finish(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.drop(_ONE) if keys == [_ONE] else df


def _join(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Attach the per-key ``value``; without keys it is a single value, read as a scalar."""
    if keys == [_ONE]:
        return left.withColumn(value, right.select(value).scalar())
    return left.join(right, keys)


def _named(category: str) -> str:
    return f"{category} IS NOT NULL AND {category} != ''"


def _slots(category: str, n: str):
    """The ranked rows of a key as one array in rank order; never more than k entries."""
    return F.expr(f"array_sort(collect_list(struct(rn, {category}, {n}))) AS _slots")


def _wide_counts(counts: DataFrame, keys: list[str], category: str, n: str, k: int, prefix: str) -> DataFrame:
    """Wide histogram from counts per (keys, category)."""
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("_total"))
    ranked = top_k_per_group(counts, keys, f"{n} DESC, {category}", k)
    wide = ranked.groupBy(*keys).agg(_slots(category, n), F.sum(n).alias("_top"))
    wide = _join(wide, totals, keys, "_total")
    columns = [*keys]
    for i in range(k):
        slot, name = f"get(_slots, {i})", f"{prefix}_{i + 1}"
        columns.append(f"{slot}.{category} AS {name}")
        columns.append(f"{slot}.{n} AS {name}_count")
        columns.append(f"{percent(f'{slot}.{n}', '_total')} AS {name}_share")
    columns.append(f"_total - _top AS {prefix}_other_count")
    columns.append(f"{percent('_total - _top', '_total')} AS {prefix}_other_share")
    return wide.selectExpr(*columns)


def category_histogram(
    df: DataFrame, keys: Sequence[str], category: str, k: int = 10, prefix: str = "tree_genus"
) -> DataFrame:
    """Wide top-k histogram per key: value, count, share in percent, and everything else as other.

    Missing and empty categories count neither as slots nor in the share denominator.
    """
    df, keys = _keyed(df, keys)
    counts = df.filter(_named(category)).groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_n"))
    return _finish(_wide_counts(counts, keys, category, "_n", k, prefix), keys)


def weighted_histogram(
    df: DataFrame,
    keys: Sequence[str],
    category: str,
    weight: str,
    k: int = 5,
    prefix: str = "forest_genus",
) -> DataFrame:
    """Wide top-k histogram of summed weights per key: value, share, other = 1 - top k.

    Sums are rounded to 6 decimals before ranking and dividing, so neither ties nor shares depend on
    the order of summation.
    """
    df, keys = _keyed(df, keys)
    weights = df.groupBy(*keys, category).agg(F.expr(f"{round_to(f'sum({weight})', 6)} AS _w"))
    totals = weights.groupBy(*keys).agg(F.expr(f"{round_to('sum(_w)', 6)} AS _total"))
    ranked = top_k_per_group(weights, keys, f"_w DESC, {category}", k)
    wide = _join(ranked.groupBy(*keys).agg(_slots(category, "_w")), totals, keys, "_total")
    columns = [*keys]
    for i in range(k):
        slot, name = f"get(_slots, {i})", f"{prefix}_{i + 1}"
        columns.append(f"{slot}.{category} AS {name}")
        columns.append(f"{percent(f'{slot}._w', '_total')} AS {name}_share")
    top = f"aggregate(_slots, 0D, (acc, slot) -> acc + {ratio('slot._w', '_total')})"
    columns.append(f"{round_to(f'(1D - {top}) * 100D', 1)} AS {prefix}_other_share")
    return _finish(wide.selectExpr(*columns), keys)


def _best(value: str, n: str) -> str:
    """Most frequent value, smallest on ties; NULL values never win."""
    return f"min(CASE WHEN {value} IS NOT NULL THEN struct(-{n} AS n, {value} AS v) END).v"


def dominant_value(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value and number of distinct values per key, from one set of counts."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.expr(_best(value, "_n")).alias(out), F.count(value).alias(f"{out}_distinct")
    )


def dominant_share(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Share in percent of the most frequent non-empty value among all rows of the key."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.groupBy(*keys).agg(
        F.expr(f"max(CASE WHEN {_named(value)} THEN _n END) AS _max"), F.sum("_n").alias("_all")
    )
    return sums.selectExpr(*keys, f"{round_to(ratio('100 * _max', '_all'), 1)} AS {out}")


def source_mix(df: DataFrame, keys: Sequence[str], source: str, values: Sequence[str]) -> DataFrame:
    """Rows per key and source as one column per source."""
    return df.groupBy(*keys).agg(
        *[F.expr(f"count_if({source} = '{v}')").alias(f"source_{v}") for v in values]
    )


def share_of_total(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Count and share of each category within its key."""
    counts = df.filter(_named(category)).groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return counts.join(totals, list(keys)).selectExpr(
        *keys, category, "n", f"{ratio('n', '_total')} AS share"
    )


def unpivot_slots(df: DataFrame, keep: Sequence[str], slots: Sequence[tuple[str, str]]) -> DataFrame:
    """(code, share) slot columns to rows in one scan; keeps codes with a positive share."""
    rows = ", ".join(f"struct(trim({c}) AS code, double({share}) AS share)" for c, share in slots)
    return df.selectExpr(*keep, f"inline(array({rows}))").filter("code IS NOT NULL AND share > 0")


def histogram_rollup(wide: DataFrame, keep: Sequence[str], k: int, stored: int = 10, prefix: str = "tree_genus") -> DataFrame:
    """A stored wide histogram shown with ``k`` rows: hidden ranks join "other".

    The other row appears only when its share exceeds 0.5 percent, else both values are NULL.
    """

    def total(kind: str) -> str:
        hidden = [f"{prefix}_{i}" for i in range(k + 1, stored + 1)] + [f"{prefix}_other"]
        return "(" + " + ".join(f"coalesce({h}_{kind}, 0)" for h in hidden) + ")"

    shown = [f"{prefix}_{i}{kind}" for i in range(1, k + 1) for kind in ("", "_count", "_share")]
    visible = f"{total('share')} > 0.5D"
    return wide.selectExpr(
        *keep,
        *shown,
        f"CASE WHEN {visible} THEN {total('count')} END AS {prefix}_other_count",
        f"CASE WHEN {visible} THEN {round_to(total('share'), 1)} END AS {prefix}_other_share",
    )


def point_profile(
    points: DataFrame, keys: Sequence[str], sources: Sequence[str], k: int = 10, weight: str = "1L"
) -> DataFrame:
    """All point statistics of a mart in one pass over the points.

    ``points`` needs ``genus``, ``species`` and ``source``; a row stands for ``weight`` points. Every row yields one row for its genus
    and one for its species; counts per (keys, kind, value) are combined on the map side and
    shuffled once, then settle. Totals, source mix, dominant values, distinct counts and the
    histogram all read those counts and never the points again.
    """
    points, keys = _keyed(points, keys)
    values = (
        "inline(array(struct(true AS g, genus AS v), struct(false AS g, nullif(species, '') AS v)))"
    )
    mix = [f"source_{s}" for s in sources]
    counts = (
        points.selectExpr(*keys, "source", f"{weight} AS _n", values)
        .groupBy(*keys, "g", "v")
        .agg(
            F.sum("_n").alias("n"),
            *[F.expr(f"sum(if(source = '{s}', _n, 0L)) AS source_{s}") for s in sources],
        )
    )
    counts = settle(counts, "counts")
    best = "min(CASE WHEN {} AND v IS NOT NULL THEN struct(-n AS n, v) END).v"
    totals = counts.groupBy(*keys).agg(
        F.expr("sum(if(g, n, 0)) AS tree_count"),
        F.expr(f"{best.format('g')} AS dominant_genus"),
        F.expr("count_if(g AND v IS NOT NULL) AS genus_count"),
        F.expr(f"{best.format('NOT g')} AS dominant_species"),
        F.expr("count_if(NOT g AND v IS NOT NULL) AS species_count"),
        F.expr("max(CASE WHEN NOT g AND v IS NOT NULL THEN n END) AS _max_species"),
        *[F.expr(f"sum(if(g, {m}, 0)) AS {m}") for m in mix],
    )
    named = counts.filter(f"g AND {_named('v')}").selectExpr(*keys, "v AS genus", "n")
    histogram = _wide_counts(named, keys, "genus", "n", k, "tree_genus")
    result = totals.join(histogram, keys, "left").selectExpr(
        *keys,
        "tree_count",
        "dominant_genus",
        "genus_count",
        "dominant_species",
        "species_count",
        f"{round_to(ratio('100 * _max_species', 'tree_count'), 1)} AS dominant_species_pct",
        *mix,
        *[c for c in histogram.columns if c not in keys],
    )
    return _finish(result, keys)
