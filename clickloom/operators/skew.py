"""Joins whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than 1 / HOT_SHARE of the rows, so that fewer than HOT_SHARE keys are.
HOT_SHARE = 1000


def split_join(many: DataFrame, lists: DataFrame, key: str, by: str) -> DataFrame:
    """many joined with lists on key, where many's rows of a hot key are dealt by `by` to parts of about 1 / HOT_SHARE of all rows.

    The rows of lists of a hot key are repeated for each of its parts; all hot keys together have fewer than 2 * HOT_SHARE parts, and they
    are broadcast. A null key joins nothing; empty tables give no rows; many is read twice.
    """
    counts = many.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    parts = F.ceil(F.col("__n") * HOT_SHARE / F.col("__total")).cast("int")
    hot = F.broadcast(counts.join(F.broadcast(total)).filter(F.col("__n") * HOT_SHARE > F.col("__total")).filter(F.col("__n") > HOT_SHARE).select("__key", parts.alias("__parts")))
    dealt = many.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__part", F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__key", "__parts")
    repeated = lists.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__key", "__parts")
    return dealt.join(repeated, [key, "__part"]).drop("__part")
