"""Joins on keys of which a few may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group is heavy if it holds more than 1/HEAVY_SHARE of all rows, so that fewer than HEAVY_SHARE groups are heavy.
HEAVY_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows with groups (one row a key, with its count of rows) on key.

    Fewer than HEAVY_SHARE keys can have more than total / HEAVY_SHARE rows: those are broadcast, a proven bound, so
    no task gathers a heavy key; all other keys are shuffled. rows is read twice and should be stored. `how` is inner
    or left; null keys match nothing and aren't shuffled.
    """
    least = max(1, total // HEAVY_SHARE)
    heavy = groups.filter(F.col(count) > least)
    light = groups.filter(F.col(count) <= least)
    names = [c for c in groups.columns if c != key]
    named = rows.filter(F.col(key).isNotNull())
    marked = named.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), key, "left")
    by_task = marked.filter(F.col("__heavy").isNotNull()).drop("__heavy")
    rest = marked.filter(F.col("__heavy").isNull()).drop("__heavy", *names).join(light, key, how)
    out = by_task.select(rest.columns).unionByName(rest)
    if how == "inner":
        return out
    nameless = rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in names])
    return out.unionByName(nameless)


def salts(count: Column, per_task: int) -> Column:
    """In how many parts a group of that count is split, so that a part holds about per_task rows."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(per_task))).cast("int")
