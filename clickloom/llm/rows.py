"""Numbers for rows whose doc_id may be null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs(doc_id, text, ...) with `name`, a number of each row that follows the order of doc_id, null last.

    Where no doc_id is null or repeated, it is the doc_id and nothing is stored. Otherwise the rows are stored, so that their numbers
    hold still, and numbered in the order of a range sort by doc_id, a hash of the text and their place; rows equal in doc_id and text
    are interchangeable.
    """
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("__n")).filter("__n > 1 OR doc_id IS NULL")
    if shared.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    kept = stored(docs.withColumn("__at", F.monotonically_increasing_id()), "numbered-rows")
    order = ["__none", "doc_id", "__tie", "__at"]
    light = kept.select(F.col("doc_id").isNull().alias("__none"), "doc_id", F.xxhash64("text").alias("__tie"), "__at")
    ranged = light.repartitionByRange(*order).sortWithinPartitions(*order).select("__at", F.monotonically_increasing_id().alias(name))
    return kept.join(stored(ranged, "row-numbers"), "__at").drop("__at")
