"""Replay of test sessions: for each click the history so far and the items that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.knn import KnnParams, recommend, recommendation_lists


def prefixes(evolving: DataFrame, last: int | None = None) -> DataFrame:
    """(SessionId, position, history, next_items) for each click but the last of evolving(eid, item, pos); history may keep its last items only.

    A session's items are packed once and sliced, so that no window repeats them.
    """
    packed = evolving.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items")).filter(F.size("items") > 1)
    rows = packed.select("eid", "items", F.explode(F.sequence(F.lit(1), F.size("items") - 1)).alias("position"))
    start = F.greatest(F.lit(1), F.col("position") - last + 1) if last else F.lit(1)
    return rows.select(F.col("eid").alias("SessionId"), "position", F.slice("items", start, F.col("position") - start + 1).alias("history"), F.slice("items", F.col("position") + 1, F.size("items")).alias("next_items"))


def as_evolving(rows: DataFrame) -> DataFrame:
    """Prefixes as evolving sessions of their own: eid is `SessionId:position`."""
    eid = F.concat_ws(":", F.col("SessionId"), F.col("position"))
    return rows.select(eid.alias("eid"), F.posexplode("history").alias("at", "item")).select("eid", "item", (F.col("at") + 1).cast("long").alias("pos"))


def predictions(evolving: DataFrame, history: DataFrame, p: KnnParams, last: int | None = None) -> DataFrame:
    """(SessionId, position, recs, next_items) of every prefix; recs is empty where nothing is recommended."""
    rows = prefixes(evolving, last)
    lists = recommendation_lists(recommend(as_evolving(rows), history, p))
    eid = F.concat_ws(":", F.col("SessionId"), F.col("position"))
    return rows.withColumn("eid", eid).join(lists, "eid", "left").select("SessionId", "position", F.coalesce("recs", F.array().cast("array<bigint>")).alias("recs"), "next_items")
