"""The driver's tables as clicks, raw events, a catalog and evolving sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.knn import numbered

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def seconds(column: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, {_EPOCH}, CAST({column} AS TIMESTAMP_NTZ))").cast("long")


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    """SessionId, ItemId, Time, pos of the order lines."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("SessionId"), F.col("l_partkey").alias("ItemId"), seconds("l_shipdate").alias("Time"), F.col("l_linenumber").cast("long").alias("pos"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    return clicks(spark, sf).filter("SessionId % 10 <> 0").select("SessionId", "ItemId", "Time")


def evolving(spark: SparkSession, sf: str) -> DataFrame:
    """(eid, item, pos) of every tenth order."""
    return numbered(clicks(spark, sf).filter("SessionId % 10 = 0"), ["pos", "ItemId"])


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Raw tracking events: views and clicks are detail pages, signups stand in for carts."""
    rows = spark.read.parquet(f"{sf}/events.parquet")
    quantity = lambda *kinds: F.col("event_type").isin(*kinds).cast("int")
    millis = F.expr(f"timestampdiff(MILLISECOND, {_EPOCH}, CAST(ts AS TIMESTAMP_NTZ))")
    return rows.select(F.col("user_id").alias("bui"), millis.alias("timestamp"), F.get_json_object("props", "$.k").cast("long").alias("item_id"), quantity("view", "click").alias("qty_detailpage"), quantity("purchase").alias("qty_purchased"), quantity("signup").alias("qty_add_to_cart"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The parts as a nested catalog: large ones are adult, brands 1 to 4 are for sale; some lack attributes."""
    rows = spark.read.parquet(f"{sf}/part.parquet")
    value = F.when(F.col("p_size") > 40, F.lit("YES")).otherwise(F.lit("no"))
    attributes = F.when(F.col("p_size") % 7 != 0, F.array(F.struct(F.lit("Erotic Content").alias("name"), F.array(F.struct(value.alias("value"))).alias("values")))).otherwise(F.array().cast("array<struct<name:string,values:array<struct<value:string>>>>"))
    return rows.select(F.col("p_partkey").alias("globalId"), F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4").alias("ForSale"), attributes.alias("attributes"))


#: The same tables as CTEs.
SQL = {
    "clicks": "SELECT l_orderkey AS SessionId, l_partkey AS ItemId, floor(epoch(l_shipdate))::BIGINT AS Time, l_linenumber::BIGINT AS pos FROM lineitem",
    "history": "SELECT SessionId, ItemId, Time FROM clicks WHERE SessionId % 10 <> 0",
    "evolving": "SELECT SessionId AS eid, ItemId AS item, row_number() OVER (PARTITION BY SessionId ORDER BY pos, ItemId) AS pos FROM clicks WHERE SessionId % 10 = 0",
    "raw": "SELECT user_id AS bui, epoch_us(ts) // 1000 AS timestamp, (props->>'$.k')::BIGINT AS item_id, (event_type IN ('view', 'click'))::INT AS qty_detailpage, (event_type = 'purchase')::INT AS qty_purchased, (event_type = 'signup')::INT AS qty_add_to_cart FROM events",
    "event_clicks": "SELECT bui, item_id AS ItemId, timestamp // 1000 AS Time, qty_detailpage, qty_purchased, qty_add_to_cart FROM raw WHERE qty_detailpage + qty_purchased > 0",
    "flags": """SELECT p_partkey AS ItemId, p_size > 40 AND p_size % 7 <> 0 AS IsAdult, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') AS ForSale
        FROM part WHERE p_partkey IN (SELECT ItemId FROM history) AND ((p_size > 40 AND p_size % 7 <> 0) OR p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4'))""",
}

#: The flags of all items that were clicked, and not of the history's alone.
SQL["all_flags"] = SQL["flags"].replace("FROM history", "FROM clicks")


def with_tables(names: str, body: str) -> str:
    """A SELECT, or CTEs and one, after the named CTEs."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + (", " + body if not body.lstrip().upper().startswith("SELECT") else " " + body)
