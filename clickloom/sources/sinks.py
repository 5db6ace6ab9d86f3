"""Sinks: predictions, latencies, indexes, JSON responses, a statistics page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prediction_line(recs: Column, nexts: Column, length: int = 20) -> Column:
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return F.concat_ws(";", joined(F.slice(recs, 1, length)), joined(nexts))


def write_predictions(predictions: DataFrame, path: str, length: int = 20) -> None:
    """Text lines `recommendations;next items`, the first `length` recommendations."""
    predictions.select(prediction_line(F.col("recs"), F.col("next_items"), length).alias("value")).write.mode("overwrite").text(path)


def write_latencies(latencies: DataFrame, path: str) -> None:
    """CSV with a header: position,latency_in_micros."""
    latencies.select("position", "latency_in_micros").write.mode("overwrite").option("header", True).csv(path)


def write_index(items: DataFrame, sessions: DataFrame, base: str, files: int = 25, format: str = "parquet") -> None:
    items.repartition(files).write.mode("overwrite").format(format).save(f"{base}/itemindex")
    sessions.repartition(files).write.mode("overwrite").format(format).save(f"{base}/sessionindex")


def json_responses(recommended: DataFrame) -> DataFrame:
    """(eid, body): the recommended ids by rank as a JSON array."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"])
    return recommended.groupBy("eid").agg(F.to_json(ids).alias("body"))


def latency_summary(latencies: DataFrame) -> DataFrame:
    """Percentiles, mean, mean of the fastest 90 percent, and the largest latency; one row."""
    bound = latencies.agg(F.percentile("latency_in_micros", F.lit(0.9)).alias("__b"))
    fast = F.avg(F.when(F.col("latency_in_micros") <= F.col("__b"), F.col("latency_in_micros"))).alias("fastest_90")
    quantiles = [F.percentile_approx("latency_in_micros", q).alias(f"p{round(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9, 0.95)]
    return latencies.join(F.broadcast(bound)).agg(*quantiles, F.avg("latency_in_micros").alias("mean"), fast, F.max("latency_in_micros").alias("most"))


def stats_page(stats: DataFrame) -> str:
    """The one row of training statistics as an HTML table."""
    row = stats.first().asDict()
    return "<table>" + "".join(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in row.items()) + "</table>"
