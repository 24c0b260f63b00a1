"""Data-quality checks, profiles and source drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions.numeric import num, percent

#: A new count below this part of the old one is a broken response, not an update.
SUSPICIOUS_DROP = 0.10


def _result(check: str, column: str, failures: Column) -> list[Column]:
    return [
        F.lit(check).alias("check"),
        F.lit(column).alias("column"),
        failures.cast("long").alias("failures"),
    ]


def expect_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(check, column, failures) per column, all columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(*_result("not_null", c, F.col(c))) for c in columns])
    return counts.select(F.inline(rows))


def expect_unique(df: DataFrame, column: str) -> DataFrame:
    """Number of non-null values that occur more than once."""
    repeated = df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1")
    return repeated.agg(F.count(F.lit(1)).alias("_f")).select(*_result("unique", column, F.col("_f")))


def expect_in_set(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Number of distinct values outside the accepted set."""
    outside = df.filter(~F.col(column).isin(*values)).select(column).distinct()
    return outside.agg(F.count(F.lit(1)).alias("_f")).select(
        *_result("accepted_values", column, F.col("_f"))
    )


def expect_min_rows(df: DataFrame, minimum: int) -> DataFrame:
    """One failure when the table has no more than ``minimum`` rows."""
    return df.agg(F.count(F.lit(1)).alias("_n")).select(
        *_result("min_rows", "*", F.when(F.col("_n") <= minimum, 1).otherwise(0))
    )


def expect_all(
    df: DataFrame, not_null: Sequence[str] = (), unique: Sequence[str] = (), in_set: Sequence[tuple[str, Sequence[str]]] = (), min_rows: int | None = None
) -> DataFrame:
    """(check, column, failures) of all rules from one scan of ``df``.

    A row tells of each rule what concerns it: a null, a value that must be unique, one outside its set.
    Equal tidings are counted before they are shuffled, so a value on a third of all rows is one row a
    task; then each rule sums up what it counts as a failure. Several sets may be tried on one column.
    """
    told = [f"if({c} IS NULL, struct({i} AS rule, cast(NULL as string) AS value), NULL)" for i, c in enumerate(not_null)]
    rules = [("not_null", c) for c in not_null]
    for c in unique:
        told.append(f"if({c} IS NOT NULL, struct({len(rules)} AS rule, cast({c} as string) AS value), NULL)")
        rules.append(("unique", c))
    for c, values in in_set:
        known = ", ".join("'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
        told.append(f"if(cast({c} as string) NOT IN ({known}), struct({len(rules)} AS rule, cast({c} as string) AS value), NULL)")
        rules.append(("accepted_values", c))
    if min_rows is not None:
        told.append(f"struct({len(rules)} AS rule, cast(NULL as string) AS value)")
        rules.append(("min_rows", "*"))
    kinds = ", ".join(f"struct({i} AS rule, '{check}' AS check, '{column}' AS column)" for i, (check, column) in enumerate(rules))
    counts = df.selectExpr(f"inline(array_compact(array({', '.join(told)})))").groupBy("rule", "value").agg(F.expr("count(1) AS n"))
    # Down to one row a rule before the join, which would bring all values of a rule to one task.
    counts = counts.groupBy("rule").agg(
        F.expr("sum(n) AS n"), F.expr("count_if(n > 1) AS repeated"), F.expr("count(1) AS values")
    )
    every = df.sparkSession.range(1).selectExpr(f"inline(array({kinds}))")
    failures = (
        "CASE check WHEN 'not_null' THEN coalesce(n, 0L) WHEN 'unique' THEN coalesce(repeated, 0L) "
        f"WHEN 'accepted_values' THEN coalesce(values, 0L) ELSE if(coalesce(n, 0L) <= {min_rows or 0}, 1L, 0L) END"
    )
    return every.join(counts, "rule", "left").selectExpr("check", "column", f"{failures} AS failures")


def profile_table(df: DataFrame, columns: Sequence[str], high_null_pct: float = 20.0) -> DataFrame:
    """(column, rows, null_pct, high_null) per column, from one pass."""
    totals = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    rows = ", ".join(
        f"struct('{c}' AS column, _rows AS rows, {percent(c, '_rows')} AS null_pct, "
        f"{percent(c, '_rows')} > {num(high_null_pct)} AS high_null)"
        for c in columns
    )
    return totals.selectExpr(f"inline(array({rows}))")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, such as geometry types."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    """(source, new_count) of landed rows."""
    return df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("new_count"))


def source_drift(
    counts: DataFrame,
    baseline: DataFrame,
    excluded: Sequence[str] = (),
    drop: float = SUSPICIOUS_DROP,
) -> DataFrame:
    """(source, old_count, new_count, status) of landed counts against the stored ones.

    ``kept``: excluded, the stored count stays. ``error``: nothing landed. ``suspicious``: fewer than
    ``drop`` of the stored count. Else ``changed`` or ``ok``.
    """
    joined = counts.select("source", "new_count").join(
        baseline.select("source", F.col("count").alias("old_count")), "source", "full"
    )
    old = F.coalesce("old_count", F.lit(0).cast("long"))
    kept = F.col("source").isin(*excluded) if excluded else F.lit(False)
    status = (
        F.when(kept, "kept")
        .when(F.col("new_count").isNull(), "error")
        .when((old > 0) & (F.col("new_count") < old * F.lit(drop)), "suspicious")
        .when(F.col("new_count") != old, "changed")
        .otherwise("ok")
    )
    new = F.when(kept, old).otherwise(F.col("new_count"))
    return joined.select("source", old.alias("old_count"), new.alias("new_count"), status.alias("status"))


def advance_baseline(drift: DataFrame, baseline: DataFrame, now: Column | None = None) -> DataFrame:
    """The next baseline: accepted counts move on, and nothing moves while any source failed."""
    failed = drift.agg(F.expr("coalesce(bool_or(status IN ('error', 'suspicious')), false)")).scalar()
    stamp = now if now is not None else F.current_timestamp()
    moves = ~failed & F.col("status").isin("ok", "changed")
    rows = drift.join(baseline, "source", "left").withColumn("_moves", moves)
    return rows.filter("count IS NOT NULL OR _moves").select(
        "source",
        F.expr("if(_moves, new_count, count) AS count"),
        F.when(F.col("_moves"), stamp).otherwise(F.col("last_checked")).alias("last_checked"),
    )


def missing_from_index(items: DataFrame, index: DataFrame, on: str) -> DataFrame:
    """Distinct values of ``items`` that the index does not hold."""
    return items.select(on).distinct().join(index.select(on), on, "left_anti")
