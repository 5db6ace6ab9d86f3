"""Ranking metrics of (recs, next_items) rows, both arrays of item ids, at a length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _top(recs: Column, length: int) -> Column:
    return F.slice(recs, 1, length)


def _double(c: Column) -> Column:
    return c.cast("double")


def mrr(recs: Column, nexts: Column, length: int) -> Column:
    """One over the rank of the next item among the first `length` recommendations, else 0."""
    rank = F.array_position(_top(recs, length), F.try_element_at(nexts, F.lit(1)))
    return F.when(rank > 0, 1 / _double(rank)).otherwise(F.lit(0.0))


def hitrate(recs: Column, nexts: Column, length: int) -> Column:
    return F.coalesce(_double(F.array_contains(_top(recs, length), F.try_element_at(nexts, F.lit(1))).cast("int")), F.lit(0.0))


def _shared(recs: Column, nexts: Column, length: int) -> Column:
    return _double(F.size(F.array_intersect(_top(recs, length), nexts)))


def precision(recs: Column, nexts: Column, length: int) -> Column:
    """Distinct shared items over `length`, however few recommendations there are."""
    return _shared(recs, nexts, length) / F.lit(float(length))


def recall(recs: Column, nexts: Column, length: int, distinct: bool = False) -> Column:
    """Distinct shared items over the next items, which count as often as they occur unless distinct."""
    n = F.size(F.array_distinct(nexts)) if distinct else F.size(nexts)
    return F.when(n > 0, _shared(recs, nexts, length) / _double(n)).otherwise(F.lit(0.0))


def _dcg(items: Column, nexts: Column) -> Column:
    gain = F.transform(items, lambda x, i: F.when(F.array_contains(nexts, x), F.when(i == 0, F.lit(1.0)).otherwise(1 / F.log2(_double(i + 1)))).otherwise(F.lit(0.0)))
    return F.aggregate(gain, F.lit(0.0), lambda a, b: a + b)


def ndcg(recs: Column, nexts: Column, length: int) -> Column:
    """Binary relevance; the first place gains 1, place i (from 0) 1 / log2(i + 1); the ideal counts repeated next items."""
    ideal = _dcg(_top(nexts, length), nexts)
    return F.when(ideal > 0, _dcg(_top(recs, length), nexts) / ideal).otherwise(F.lit(0.0))


def average_precision(recs: Column, nexts: Column, length: int) -> Column:
    """Sum over prefixes of 0 to length - 1 items of precision (over `length`) times the growth of recall."""
    found = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: _double(F.size(F.array_intersect(F.slice(recs, F.lit(1), i), nexts))))
    n = _double(F.size(nexts))
    step = F.transform(found, lambda x, i: x / F.lit(float(length)) * (x - F.when(i > 0, F.get(found, i - 1)).otherwise(F.lit(0.0))) / n)
    return F.when(n > 0, F.aggregate(step, F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))


def popularity_table(clicks: DataFrame) -> DataFrame:
    """(ItemId, popularity): clicks of the item over those of the most clicked one."""
    counts = clicks.groupBy("ItemId").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most)).select("ItemId", (F.col("n") / F.col("most")).alias("popularity"))


def popularity(predictions: DataFrame, clicks: DataFrame, length: int) -> DataFrame:
    """Mean over rows of the mean popularity of the distinct first recommendations; unknown items and empty lists add 0 but count."""
    numbered = predictions.select(F.monotonically_increasing_id().alias("__row"), F.array_distinct(_top(F.col("recs"), length)).alias("top"))
    each = numbered.select("__row", F.size("top").alias("n"), F.explode_outer("top").alias("ItemId")).join(popularity_table(clicks), "ItemId", "left")
    rows = each.groupBy("__row").agg((F.sum(F.coalesce("popularity", F.lit(0.0))) / F.greatest(F.max("n"), F.lit(1))).alias("p"))
    return rows.agg(F.avg("p").alias("popularity"))


def coverage(predictions: DataFrame, clicks: DataFrame, length: int) -> DataFrame:
    """Distinct recommended items over distinct items of the training clicks."""
    seen = predictions.select(F.explode(_top(F.col("recs"), length)).alias("i")).agg(F.countDistinct("i").alias("seen"))
    return seen.join(F.broadcast(clicks.agg(F.countDistinct("ItemId").alias("all")))).select((F.col("seen") / F.col("all")).alias("coverage"))


def means(predictions: DataFrame, length: int) -> DataFrame:
    """One row: the means of all row metrics, and f1 of mean precision and mean recall."""
    r, n = F.col("recs"), F.col("next_items")
    row = predictions.agg(*[F.avg(f(r, n, length)).alias(name) for name, f in ROW_METRICS.items()])
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return row.withColumn("f1", f1)


ROW_METRICS = {"mrr": mrr, "hitrate": hitrate, "precision": precision, "recall": recall, "ndcg": ndcg, "map": average_precision}


def report(predictions: DataFrame, clicks: DataFrame, length: int = 20) -> DataFrame:
    """One row with all metrics, rounded to four digits."""
    out = means(predictions, length).join(F.broadcast(coverage(predictions, clicks, length))).join(F.broadcast(popularity(predictions, clicks, length)))
    return out.select(*[F.round(c, 4).alias(c) for c in ("mrr", "ndcg", "hitrate", "popularity", "precision", "coverage", "recall", "f1", "map")])


def by_position(predictions: DataFrame, length: int) -> DataFrame:
    """Mean MRR and hit rate for each position in the session."""
    r, n = F.col("recs"), F.col("next_items")
    return predictions.groupBy("position").agg(F.avg(mrr(r, n, length)).alias("mrr"), F.avg(hitrate(r, n, length)).alias("hitrate"), F.count("*").alias("n"))


def by_popularity(predictions: DataFrame, clicks: DataFrame, length: int, bins: int = 10) -> DataFrame:
    """Mean MRR and hit rate for each bin of the next item's popularity; unknown items fall into bin 0."""
    r, n = F.col("recs"), F.col("next_items")
    scored = predictions.select(F.try_element_at(n, F.lit(1)).alias("ItemId"), mrr(r, n, length).alias("m"), hitrate(r, n, length).alias("h"))
    bucket = F.least(F.lit(bins - 1), F.floor(F.coalesce("popularity", F.lit(0.0)) * bins)).cast("int")
    return scored.join(popularity_table(clicks), "ItemId", "left").groupBy(bucket.alias("pop_bin")).agg(F.avg("m").alias("mrr"), F.avg("h").alias("hitrate"), F.count("*").alias("n"))
