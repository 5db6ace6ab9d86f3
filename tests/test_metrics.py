import pytest
from pyspark.sql import functions as F

from clickloom.functions import metrics

RECS = list(range(1, 25))


def value(spark, f, recs, nexts, **kw):
    df = spark.createDataFrame([(recs, nexts)], "recs array<long>, next_items array<long>")
    return df.select(f(F.col("recs"), F.col("next_items"), 20, **kw).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "f, nexts, want, kw",
    [
        (metrics.mrr, [3, 55, 3, 4], 1 / 3, {}),
        (metrics.ndcg, [3, 55, 88, 4], 0.36121211352040195, {}),
        (metrics.precision, [3, 55, 3, 4], 0.1, {}),
        (metrics.recall, [3, 55, 3, 4], 0.5, {}),
        (metrics.recall, [3, 55, 3, 4], 2 / 3, {"distinct": True}),
        (metrics.hitrate, [55], 0.0, {}),
        (metrics.mrr, [24], 0.0, {}),
        (metrics.mrr, [], 0.0, {}),
        (metrics.ndcg, [], 0.0, {}),
        (metrics.average_precision, [], 0.0, {}),
    ],
)
def test_fixed_values(spark, f, nexts, want, kw):
    assert abs(value(spark, f, RECS, nexts, **kw) - want) < 1e-12


def test_hitrate_and_f1(spark):
    df = spark.createDataFrame([([1, 2], [2, 3])], "recs array<long>, next_items array<long>")
    row = metrics.means(df, 20).first()
    assert row["hitrate"] == 1.0 and abs(row["f1"] - 0.09090909090909091) < 1e-12
    none = spark.createDataFrame([([], [2])], "recs array<long>, next_items array<long>")
    assert metrics.means(none, 20).first()["f1"] == 0.0


def test_coverage_popularity_and_bins(spark):
    clicks = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "SessionId long, ItemId long")
    df = spark.createDataFrame([([1, 2, 9], [2], 1), ([], [7], 2)], "recs array<long>, next_items array<long>, position int")
    assert metrics.coverage(df, clicks, 20).first()[0] == 1.0
    assert metrics.popularity(df, clicks, 20).first()[0] == pytest.approx((1 + 0.5) / 3 / 2)
    assert {r["pop_bin"]: r["n"] for r in metrics.by_popularity(df, clicks, 20).collect()} == {5: 1, 0: 1}
    assert {r["position"]: r["mrr"] for r in metrics.by_position(df, 20).collect()} == {1: 0.5, 2: 0.0}
