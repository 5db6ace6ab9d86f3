import math

import pytest

from clickloom.operators import index, knn
from clickloom.operators.knn import KnnParams, recommend
from clickloom.plans.models import SessionKnn


def history(spark, sessions, times=None):
    rows = [(s, i, (times or {}).get(s, 1)) for s, items in sessions.items() for i in items]
    return spark.createDataFrame(rows, "SessionId long, ItemId long, Time long")


def evolving(spark, *sessions):
    return spark.createDataFrame([(e, i, n + 1) for e, items in enumerate(sessions) for n, i in enumerate(items)], "eid long, item long, pos long")


def test_first_item_needs_the_idf_of_pairs(spark):
    h = history(spark, {0: [920006, 920005, 920004], 1: [920005, 920004, 920003, 920002]})
    rows = recommend(evolving(spark, [920005]), h, KnnParams(m=500, k=500, idf="pairs")).orderBy("rank").collect()
    assert len(rows) == 4 and {r["item"] for r in rows} == {920006, 920004, 920003, 920002}
    top = {r["item"]: r["score"] for r in rows}
    assert math.isclose(top[920004], 2 * 0.9 * math.log(7 / 2)) and rows[0]["item"] == 920004


def test_toy_oracle(spark):
    h = history(spark, {0: [1, 2, 3, 4, 5], 1: [2], 2: [3, 5], 3: [2, 3, 5]})
    p = KnnParams(m=500, k=2)
    near = {r["sid"]: r["sim"] for r in knn.neighbours(evolving(spark, [2, 3, 1]), h, p).collect()}
    assert math.isclose(near[0], 2.0) and math.isclose(near[3], 1.0)
    rows = {r["item"]: r["score"] for r in recommend(evolving(spark, [2, 3, 1]), h, p).collect()}
    assert len(rows) == 4
    assert abs(rows[4] - 2.495330) < 1e-4 and abs(rows[5] - 0.747973) < 1e-4
    assert recommend(evolving(spark, [2, 3, 1, 4]), h, p).count() > 0


def test_top_k_prefers_newer_sessions_and_m_cuts_old_ones(spark):
    h = history(spark, {s: [1, 100 + s] for s in range(10)}, {s: s for s in range(10)})
    e = evolving(spark, [1])
    assert sorted(r["sid"] for r in knn.neighbours(e, h, KnnParams(m=500, k=2)).collect()) == [8, 9]
    assert sorted(r["sid"] for r in knn.candidates(e, h, KnnParams(m=3, k=2)).collect()) == [7, 8, 9]
    assert sorted(r["sid"] for r in knn.neighbours(e, h, KnnParams(m=500, k=2, tie="lower_id")).collect()) == [0, 1]


@pytest.mark.parametrize("mode, want", [("pairs", math.log(5 / 2)), ("sessions", math.log(3 / 2)), ("rows", math.log(3 / 3)), ("interactions", math.log(6 / 3))])
def test_idf_modes(spark, mode, want):
    h = spark.createDataFrame([(1, 7, 0), (1, 7, 1), (2, 7, 0), (2, 8, 0), (3, 9, 0), (1, 8, 0)], "SessionId long, ItemId long, Time long")
    assert math.isclose({r["ItemId"]: r["idf"] for r in index.item_idf(h, mode).collect()}[7], want, abs_tol=1e-12)


def test_every_variant_keeps_its_promises(spark):
    h = history(spark, {s: [s % 7, s % 5, 10 + s % 3] for s in range(60)}, {s: s for s in range(60)})
    e = evolving(spark, [1, 2, 10], [3], [99])
    for name in knn.VARIANTS:
        rows = SessionKnn(knn.variant(name, n=4)).fit(h).predict(e).collect()
        assert {r["eid"] for r in rows} == {0, 1} and all(1 <= r["rank"] <= 4 for r in rows)
        assert not any((r["eid"], r["item"]) in {(0, 10), (1, 3)} for r in rows)
    assert not {r["item"] for r in recommend(e, h, KnnParams(remind=False)).filter("eid = 0").collect()} & {1, 2, 10}


def test_business_rules(spark):
    h = history(spark, {0: [1, 2, 3, 4, 5]})
    flags = spark.createDataFrame([(1, False, True), (2, True, True), (3, False, False), (4, False, True), (6, True, True)], "ItemId long, IsAdult boolean, ForSale boolean")
    model = SessionKnn(KnnParams(idf="pairs")).fit(h, flags)
    assert {r["item"] for r in model.predict(evolving(spark, [1]), True).collect()} == {4}
    assert {r["item"] for r in model.predict(evolving(spark, [2]), True).collect()} == {1, 4}
    assert {r["item"] for r in model.predict(evolving(spark, [5]), True).collect()} == {1, 4}
    assert model.extend(history(spark, {9: [1, 4]})).find_neighbours(evolving(spark, [1])).count() == 2


def test_sessions_held_as_a_table_grow_and_end(spark):
    from clickloom.plans.models import EvolvingKnn, SessionKnn

    history = spark.createDataFrame([(s, i, s) for s in range(1, 6) for i in (s, s + 1, s + 2)], "SessionId long, ItemId long, Time long")
    first = spark.createDataFrame([("a", 2, 1), ("b", 3, 1)], "eid string, item long, pos long")
    later = spark.createDataFrame([("a", 3, 1), ("c", 4, 1)], "eid string, item long, pos long")
    held = EvolvingKnn(SessionKnn("serving").fit(history), first).add(later)
    assert sorted(map(tuple, held.ages().collect())) == [("a", 2, 1, 1), ("a", 3, 2, 0), ("b", 3, 1, 0), ("c", 4, 1, 0)]
    whole = SessionKnn("serving").fit(history).predict(held.evolving)
    assert sorted(map(tuple, held.predict_next().collect())) == sorted(map(tuple, whole.collect()))
    gone = spark.createDataFrame([("b",)], "eid string")
    assert {r["eid"] for r in held.predict_next(skip=gone).collect()} == {"a", "c"}
    assert {r["eid"] for r in held.clear(gone).evolving.collect()} == {"a", "c"}


def test_a_hot_item_is_dealt_to_parts_and_loses_no_pair(spark):
    from clickloom.operators.skew import split_join

    # Item 7 holds a third of the rows and is hot; null items join nothing.
    many = spark.range(6000).selectExpr("id AS eid", "IF(id % 3 = 0, 7, IF(id % 600 = 1, NULL, 100 + id)) AS item")
    lists = spark.createDataFrame([(7, "a"), (7, "b"), (101, "c"), (100 + 2, "d"), (None, "e")], "item long, list string")
    rows, named = many.collect(), lists.collect()
    got = sorted(tuple(r) for r in split_join(many, lists, "item", "eid").select("eid", "item", "list").collect())
    want = sorted((r["eid"], r["item"], x["list"]) for r in rows for x in named if r["item"] is not None and r["item"] == x["item"])
    assert got == want and len(got) == 2 * 2000 + 1
    assert split_join(many.limit(0), lists, "item", "eid").count() == 0
    assert split_join(many, lists.limit(0), "item", "eid").count() == 0
