from pyspark.ml import Pipeline

from clickloom.operators import clean, index
from clickloom.transformers import DeIdentifyColumn, MinimumColumnSupport, MostRecentSessionItem, SelectCommerciallyViableCustomers, Sessionizer


def events(spark, rows):
    return spark.createDataFrame(rows, "bui string, timestamp long, item_id long, qty_detailpage int, qty_purchased int, qty_add_to_cart int")


def test_a_gap_of_just_the_limit_opens_a_session(spark):
    rows = [("a", t * 1000 + 999, n, 1, 1, 0) for n, t in enumerate((0, 1200, 2399, 2399))]
    out = clean.sessionize(clean.as_clicks(events(spark, rows))).collect()
    assert sorted(r["SessionId"] for r in out) == ["a_1", "a_2", "a_2", "a_2"]
    assert sorted(r["Time"] for r in out) == [0, 1200, 2399, 2399]


def test_cart_events_alone_are_gone_before_buyers_are_picked(spark):
    df = events(spark, [("a", 1000, 1, 0, 0, 1), ("a", 2000, 2, 1, 0, 0), ("a", 3000, 3, 0, 1, 0), ("b", 1000, 1, 1, 0, 0)])
    out = clean.buyers_clicks(clean.as_clicks(clean.relevant_events(df))).collect()
    assert [(r["bui"], r["ItemId"]) for r in out] == [("a", 2)]


def test_support_and_outliers(spark):
    rows = [(s, i, s) for s in range(12) for i in range(1 + s % 4)] + [(99, i, 5) for i in range(40)]
    df = spark.createDataFrame(rows, "SessionId long, ItemId long, Time long")
    kept = clean.min_support(df, "ItemId", 5).select("ItemId").distinct().collect()
    assert {r[0] for r in kept} == {0, 1, 2}
    cascade = clean.support_cascade(df).groupBy("SessionId").count().collect()
    assert all(r["count"] >= 2 for r in cascade)
    assert clean.without_long_sessions(df, 0.9).filter("SessionId = 99").count() == 0
    assert clean.without_long_sessions(df, 1.0).count() == df.count()
    assert clean.without_long_sessions(df, 1.0, strict=True).filter("SessionId = 99").count() == 0
    assert clean.min_support(df.limit(0), "ItemId", 5).count() == 0


def test_days_dense_ids_and_dwell(spark):
    assert clean.days_before("2024-03-01", 2) == ["2024-03-01", "2024-02-29", "2024-02-28"]
    df = spark.createDataFrame([(f"s{i:03}", 1, i * 3600, 1) for i in range(100)], "SessionId string, ItemId long, Time long, pos int")
    ids = clean.dense_ids(df, "SessionId", "n").collect()
    assert sorted((r["n"], r["SessionId"]) for r in ids) == [(i, f"s{i:03}") for i in range(100)]
    assert clean.last_days(df, 1).count() == 28
    d = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 10, 2), (1, 3, 30, 3), (2, 1, 5, 1)], "SessionId long, ItemId long, Time long, pos int")
    assert {(r["SessionId"], r["ItemId"]): r["weight"] for r in clean.dwell_weights(d).collect()} == {(1, 1): 0.5, (1, 2): 1.0, (1, 3): 1.0, (2, 1): 1.0}


def test_pipeline_of_transformers(spark, tmp_path):
    rows = [(f"v{b}", (b * 7 + n * 60) * 1000, n % 4, 1, n % 2, 0) for b in range(8) for n in range(12)]
    steps = [SelectCommerciallyViableCustomers(), Sessionizer(gap=3600), MostRecentSessionItem(), MinimumColumnSupport(inputCol="ItemId", min_support=5), DeIdentifyColumn(inputCol="SessionId", outputCol="SessionIndex")]
    df = clean.as_clicks(events(spark, rows))
    out = Pipeline(stages=steps).fit(df).transform(df)
    assert out.select("SessionIndex").distinct().count() == 8 and out.count() == 32
    steps[3].save(str(tmp_path / "step"))
    again = MinimumColumnSupport.load(str(tmp_path / "step"))
    assert again.getOrDefault(again.min_support) == 5


def test_catalog_flags_and_subgraph(spark):
    catalog = spark.createDataFrame(
        [(1, True, [("Erotic Content", [("Yes",)])]), (2, False, [("Erotic Content", [("no",), ("YES",)])]), (3, True, []), (4, False, []), (5, True, None)],
        "globalId long, ForSale boolean, attributes array<struct<name:string,values:array<struct<value:string>>>>",
    )
    items = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6)], "ItemId long")
    got = {r["ItemId"]: (r["IsAdult"], r["ForSale"]) for r in index.flagged_index(items, index.catalog_flags(catalog, items)).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, True), 4: (False, False), 6: (False, False)}
    h = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 2, 1), (2, 3, 1), (3, 3, 2)], "SessionId long, ItemId long, Time long")
    near, sessions = index.seed_subgraph(index.item_index(h), 2)
    assert {r["ItemId"]: r["session_indices_time_ordered"] for r in near.collect()} == {1: [1], 2: [2, 1], 3: [2]}
    assert {r["SessionId"]: r["item_ids_asc"] for r in sessions.collect()} == {1: [1, 2], 2: [2, 3]}


def test_last_items_of_equal_clicks_do_not_depend_on_the_rows_order(spark):
    rows = [(1, 7, 30, 2), (1, 7, 10, 2), (1, 7, 20, 2), (1, 9, 5, 1)]
    for given in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = clean.last_items(spark.createDataFrame(given, "SessionId long, ItemId long, Time long, pos long").coalesce(1), 2).collect()
        assert sorted(r["Time"] for r in got) == [10, 20]
