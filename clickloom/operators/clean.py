"""Cleaning and sessionizing of click events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored


def relevant_events(events: DataFrame) -> DataFrame:
    """Events with a detail page view or a purchase; mere add-to-cart events go."""
    return events.filter(F.col("qty_detailpage") + F.col("qty_purchased") > 0)


def as_clicks(events: DataFrame) -> DataFrame:
    """bui, ItemId, Time in whole seconds (milliseconds cut off) and the quantities."""
    time = F.floor(F.col("timestamp") / 1000).cast("long")
    return events.select("bui", F.col("item_id").alias("ItemId"), time.alias("Time"), "qty_detailpage", "qty_purchased", "qty_add_to_cart")


def buyers_clicks(clicks: DataFrame) -> DataFrame:
    """Clicks (detail page or cart) of visitors with at least one purchase."""
    buyers = clicks.filter("qty_purchased > 0").select("bui").distinct()
    return clicks.filter("qty_detailpage + qty_add_to_cart > 0").join(buyers, "bui", "left_semi")


def sessionize(clicks: DataFrame, gap: int = 1200) -> DataFrame:
    """SessionId bui_n: a click opens a session unless it comes less than gap seconds after the one before; equal times share one."""
    visitor = Window.partitionBy("bui").orderBy("Time")
    new = F.when(F.col("Time") - F.lag("Time").over(visitor) < gap, 0).otherwise(1)
    # The running sum's default frame takes in all clicks of the same time.
    return clicks.withColumn("__new", new).withColumn("SessionId", F.concat(F.col("bui").cast("string"), F.lit("_"), F.sum("__new").over(visitor).cast("string"))).drop("__new")


def latest_clicks(clicks: DataFrame) -> DataFrame:
    """One row for each session and item with its last time."""
    return clicks.groupBy("SessionId", "ItemId").agg(F.max("Time").alias("Time"))


def min_support(df: DataFrame, column: str, least: int) -> DataFrame:
    """Rows whose value of column occurs at least that often: counts are partial sums, so a common value isn't gathered."""
    often = df.groupBy(column).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(column)
    return df.join(often, column, "left_semi").select(df.columns)


def support_cascade(clicks: DataFrame, session: int = 2, item: int = 5) -> DataFrame:
    """Sessions, then items, then sessions again of least support; once each, not to a fixpoint."""
    return min_support(min_support(min_support(clicks, "SessionId", session), "ItemId", item), "SessionId", session)


def session_stats(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("SessionId").agg(F.count("*").alias("n"), F.max("Time").alias("Time"))


def without_long_sessions(clicks: DataFrame, share: float = 0.995, strict: bool = False, rounded: bool = False) -> DataFrame:
    """Clicks of sessions no longer (strict: shorter) than the exact interpolated percentile of session lengths."""
    stats = session_stats(clicks)
    limit: Column = F.percentile("n", F.lit(share))
    bound = stats.agg((F.round(limit) if rounded else limit).alias("__bound"))
    keep = F.col("n") < F.col("__bound") if strict else F.col("n") <= F.col("__bound")
    fit = stats.join(F.broadcast(bound), keep).select("SessionId")
    return clicks.join(fit, "SessionId", "left_semi").select(clicks.columns)


def last_days(clicks: DataFrame, days: int) -> DataFrame:
    """Clicks from midnight (UTC), so many days before the last click's day, on."""
    bound = clicks.agg((F.floor(F.max("Time") / 86400) * 86400 - days * 86400).alias("__bound"))
    return clicks.join(F.broadcast(bound), F.col("Time") >= F.col("__bound")).drop("__bound")


def top_sessions_per_item(clicks: DataFrame, m: int) -> DataFrame:
    """Clicks among the m most recent ones of their item; the session with the larger id comes first among equal times."""
    recent = Window.partitionBy("ItemId").orderBy(F.desc("Time"), F.desc("SessionId"))
    return clicks.withColumn("rank", F.row_number().over(recent)).filter(F.col("rank") <= m)


def sanitize_training(clicks: DataFrame, m: int, max_items: int) -> DataFrame:
    """Clicks of sessions with at most max_items distinct items, each among its item's m most recent sessions."""
    pairs = clicks.groupBy("SessionId", "ItemId").agg(F.max("Time").alias("own"))
    sessions = pairs.groupBy("SessionId").agg(F.count("*").alias("n"), F.max("own").alias("Time")).filter(F.col("n") <= max_items)
    return top_sessions_per_item(pairs.drop("own").join(sessions.drop("n"), "SessionId"), m).select("SessionId", "ItemId", "Time")


def last_items(clicks: DataFrame, x: int) -> DataFrame:
    """The last x clicks of each session by pos, then item; of clicks equal in both the earlier is taken first, so that reruns agree."""
    back = Window.partitionBy("SessionId").orderBy(F.desc("pos"), F.desc("ItemId"), "Time")
    return clicks.withColumn("__r", F.row_number().over(back)).filter(F.col("__r") <= x).drop("__r")


def first_rows(clicks: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in that order: each task keeps its own first n."""
    return clicks.orderBy(*order).limit(n)


def days_before(end: str, days: int) -> list[str]:
    """The end date and the days before it, newest first, as yyyy-mm-dd."""
    import datetime

    last = datetime.date.fromisoformat(end)
    return [(last - datetime.timedelta(days=i)).isoformat() for i in range(days + 1)]


def dwell_weights(clicks: DataFrame) -> DataFrame:
    """Each click's seconds to the next one over the longest such gap of its session; the last click, and any without gaps, weigh 1."""
    order = Window.partitionBy("SessionId").orderBy("Time", "pos", "ItemId")
    gap = clicks.withColumn("gap", F.lead("Time").over(order) - F.col("Time"))
    longest = F.max("gap").over(Window.partitionBy("SessionId"))
    weight = F.when(F.col("gap").isNull() | (longest == 0), F.lit(1.0)).otherwise(F.col("gap") / longest)
    return gap.withColumn("weight", weight).drop("gap")


def dense_ids(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): the distinct values numbered from 0 in order, by blocks of a range sort, without one task that sorts all."""
    values = stored(df.select(column).distinct().repartitionByRange(column).withColumn("__block", F.spark_partition_id()), "dense-ids")
    counts = values.groupBy("__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__block").orderBy(column)) - 1
    return values.withColumn("__place", place).join(F.broadcast(counts.select("__block", before.alias("__before"))), "__block").select(column, (F.col("__before") + F.col("__place")).alias(out))
