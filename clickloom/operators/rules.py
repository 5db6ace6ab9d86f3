"""Business rules on recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def passes_rules(scores: DataFrame, current: DataFrame, flags: DataFrame) -> DataFrame:
    """scores(eid, item, ...) that may be shown after current(eid, item): known, for sale, and adult only where the current item is known and adult."""
    own = flags.select(F.col("ItemId").alias("item"), F.col("IsAdult").alias("__adult"), F.col("ForSale").alias("__sale"))
    seen = current.join(own, "item").select("eid", F.col("__adult").alias("__current"))
    allowed = ~F.col("__adult") | F.coalesce("__current", F.lit(False))
    return scores.join(own, "item").filter("__sale").join(seen, "eid", "left").filter(allowed).select(scores.columns)
