"""Joining rows to one row per group when a single group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many groups are broadcast.
HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups``, which has one row per key and the group's row count in ``size``.

    Pass settled frames: both are read twice. Groups holding more than a thousandth of all rows number
    under ``HOT_GROUPS``; those are broadcast and their rows never move. All others are joined by a
    shuffle, in which no key has more than that share. Without a large group it is a plain join.
    """
    total, most = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    limit = max(total // HOT_GROUPS, 2000)
    if most <= limit:
        return rows.join(groups, keys, how)
    hot, rest = groups.filter(F.col(size) > limit), groups.filter(F.col(size) <= limit)
    cold_rows = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    out = cold_rows.join(rest, keys, how)
    return rows.join(F.broadcast(hot), keys).select(*out.columns).unionByName(out)
