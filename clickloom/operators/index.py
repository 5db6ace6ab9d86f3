"""Session and item indexes, IDF weights, training statistics and catalog flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import latest_clicks, top_sessions_per_item


def session_index(clicks: DataFrame) -> DataFrame:
    """SessionId, its distinct items in ascending order, its last time."""
    return clicks.groupBy("SessionId").agg(F.sort_array(F.collect_set("ItemId")).alias("item_ids_asc"), F.max("Time").alias("Time"))


def item_idf(clicks: DataFrame, mode: str = "sessions") -> DataFrame:
    """(ItemId, idf): ln(N / df). pairs: N all session-item pairs, df the item's. sessions: N sessions, df those with the
    item. rows: N sessions, df the item's clicks. interactions: N and df count clicks."""
    pairs = clicks.select("SessionId", "ItemId").distinct()
    if mode in ("pairs", "sessions"):
        df = pairs.groupBy("ItemId").agg(F.count("*").alias("df"))
    else:
        df = clicks.groupBy("ItemId").agg(F.count("*").alias("df"))
    if mode == "pairs":
        total = pairs.agg(F.count("*").alias("N"))
    elif mode == "interactions":
        total = clicks.agg(F.count("*").alias("N"))
    elif mode in ("sessions", "rows"):
        total = clicks.agg(F.countDistinct("SessionId").alias("N"))
    else:
        raise ValueError(mode)
    return df.join(F.broadcast(total)).select("ItemId", F.log(F.col("N") / F.col("df")).alias("idf"))


def postings(clicks: DataFrame, m: int) -> DataFrame:
    """(ItemId, SessionId, Time): each item's m most recent sessions; Time is the session's last."""
    pairs = clicks.select("SessionId", "ItemId").distinct()
    times = clicks.groupBy("SessionId").agg(F.max("Time").alias("Time"))
    return top_sessions_per_item(pairs.join(times, "SessionId"), m).select("ItemId", "SessionId", "Time", "rank")


def item_index(clicks: DataFrame, m: int = 500, idf_mode: str = "sessions") -> DataFrame:
    """ItemId, its sessions newest first (m at most), its idf."""
    lists = postings(clicks, m).groupBy("ItemId").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "SessionId"))), lambda x: x["SessionId"]).alias("session_indices_time_ordered"))
    return lists.join(item_idf(clicks, idf_mode), "ItemId")


def training_stats(clicks: DataFrame) -> DataFrame:
    """One row: records, sessions, items, first and last time, percentiles of session length and duration."""
    sessions = clicks.groupBy("SessionId").agg(F.count("*").alias("n"), (F.max("Time") - F.min("Time")).alias("duration"))
    shares = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_5": 0.995, "p100": 1.0}
    lengths = sessions.agg(*[F.round(F.percentile(c, F.lit(s))).cast("long").alias(f"{c}_{k}") for c in ("n", "duration") for k, s in shares.items()])
    totals = clicks.agg(F.count("*").alias("records"), F.countDistinct("SessionId").alias("sessions"), F.countDistinct("ItemId").alias("items"), F.min("Time").alias("first"), F.max("Time").alias("last"))
    return totals.join(F.broadcast(lengths))


def catalog_flags(catalog: DataFrame, index_items: DataFrame) -> DataFrame:
    """ItemId, IsAdult, ForSale of the index's items, from catalog(globalId, ForSale, attributes: array<struct<name, values>>).

    Adult: an attribute 'Erotic Content' with a value 'yes' in any case; items found by only one of the flags have false for the other.
    """
    known = catalog.join(index_items.select(F.col("ItemId").alias("globalId")).distinct(), "globalId", "left_semi")
    values = known.select("globalId", F.explode("attributes").alias("a")).filter(F.col("a.name").isin("Erotic Content")).select("globalId", F.explode("a.values").alias("v"))
    adult = values.filter(F.lower("v.value") == "yes").select("globalId").distinct().withColumn("IsAdult", F.lit(True))
    sale = known.groupBy("globalId").agg(F.max("ForSale").alias("ForSale")).filter("ForSale")
    both = adult.join(sale, "globalId", "outer")
    return both.select(F.col("globalId").alias("ItemId"), F.coalesce("IsAdult", F.lit(False)).alias("IsAdult"), F.coalesce("ForSale", F.lit(False)).alias("ForSale"))


def flagged_index(index: DataFrame, flags: DataFrame) -> DataFrame:
    """The item index with its flags, false for items that the catalog lacks."""
    return index.join(flags, "ItemId", "left").na.fill(False, ["IsAdult", "ForSale"])


def seed_subgraph(index: DataFrame, seed_item: int) -> tuple[DataFrame, DataFrame]:
    """(item index, session index) around a seed item: its sessions, all their items, and those items' postings among these sessions."""
    links = index.select("ItemId", F.posexplode("session_indices_time_ordered").alias("rank", "SessionId"))
    sessions = links.filter(F.col("ItemId") == seed_item).select("SessionId").distinct()
    near = links.join(sessions, "SessionId", "left_semi")
    items = near.groupBy("ItemId").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "SessionId"))), lambda x: x["SessionId"]).alias("session_indices_time_ordered"))
    flags = [F.max(c).alias(c) for c in index.columns if c in ("idf", "ForSale", "IsAdult")]
    items = items.join(index.groupBy("ItemId").agg(*flags), "ItemId") if flags else items
    return items, near.groupBy("SessionId").agg(F.sort_array(F.collect_set("ItemId")).alias("item_ids_asc"))


def clean_index_input(clicks: DataFrame, share: float = 0.995) -> DataFrame:
    """Deduplicated clicks of supported, not overlong sessions, as the index job takes them."""
    from .clean import support_cascade, without_long_sessions

    return without_long_sessions(support_cascade(latest_clicks(clicks)), share)
