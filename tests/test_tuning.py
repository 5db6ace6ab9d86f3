import random
from dataclasses import replace

import __spark_entry__ as entry
from clickloom.functions import metrics
from clickloom.operators.knn import KnnParams
from clickloom.plans import replay, tuning


def test_search_equals_one_replay_for_each_combination(spark):
    rng = random.Random(3)
    past = [(s, rng.randrange(12), 100 * s + n) for s in range(60) for n in range(rng.randrange(1, 5))]
    now = [(s, rng.randrange(14), n) for s in range(12) for n in range(1, rng.randrange(2, 8))]
    history = spark.createDataFrame(past, "SessionId long, ItemId long, Time long")
    evolving = spark.createDataFrame(now, "eid long, item long, pos long")
    combos = tuning.grid(spark, {"m": [3, 8, 100], "k": [2, 5, 50], "max_items": [1, 3, 10]})
    got = {(r["m"], r["k"], r["max_items"]): r["mrr"] for r in tuning.search(evolving, history, combos, 5).collect()}
    assert len(got) == 18  # k <= m
    for m, k, x in [(3, 2, 3), (8, 5, 1), (8, 5, 10), (100, 2, 3), (100, 50, 10)]:
        want = metrics.means(replay.predictions(evolving, history, replace(KnnParams(), m=m, k=k, n=5), x), 5).first()["mrr"]
        assert abs(got[m, k, x] - want) < 1e-9
    assert len(set(got.values())) > 5


def test_a_registered_search_covers_the_published_grid(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(tuning, "search", lambda e, h, combos, *a, f=tuning.search: asked.append(combos) or f(e, h, combos, *a))
    row = entry.queries()["hyperparam_search"](spark, "/root/testdata/sf0.001").first()
    assert asked[0].filter("k <= m").count() == 133
    assert all(row[c] in tuning.SEARCH_GRID[c] for c in ("m", "k", "max_items")) and row["mrr"] > 0


def test_a_search_in_parts_equals_one_at_once(spark, monkeypatch):
    rng = random.Random(4)
    history = spark.createDataFrame([(s, rng.randrange(12), 100 * s + n) for s in range(40) for n in range(3)], "SessionId long, ItemId long, Time long")
    evolving = spark.createDataFrame([(s, rng.randrange(14), n) for s in range(12) for n in range(1, 5)], "eid long, item long, pos long")
    found, written = [], []
    monkeypatch.setattr(tuning, "stored", lambda df, name, f=tuning.stored: written.append(name) or f(df, name))
    for at_once in (10**9, 40):
        monkeypatch.setattr(tuning, "CLICKS_AT_ONCE", at_once)
        combos = tuning.grid(spark, {"m": [3, 100], "k": [2, 50], "max_items": [1, 10]})
        found.append({(r["m"], r["k"], r["max_items"]): round(r["mrr"], 9) for r in tuning.search(evolving, history, combos, 5).collect()})
    assert found[0] == found[1] and len(found[0]) == 6
    assert written.count("search-sums") > 2


def test_only_prefixes_whose_next_item_a_session_can_recommend_are_searched(spark, monkeypatch):
    history = spark.createDataFrame([(s, i, s) for s, items in enumerate([(1, 2), (3, 4), (5, 6), (7, 8, 9)]) for i in items], "SessionId long, ItemId long, Time long")
    clicks = {10: [1, 2, 9], 11: [3, 5], 12: [1, 7, 2], 13: [9, 99, 8, 7], 14: [4]}
    # Positions with gaps are numbered anew.
    evolving = spark.createDataFrame([(e, i, 10 * n) for e, items in clicks.items() for n, i in enumerate(items)], "eid long, item long, pos long")
    tables = {}
    monkeypatch.setattr(tuning, "stored", lambda df, name, f=tuning.stored: tables.setdefault(name, f(df, name)))
    got = {r["max_items"]: r["mrr"] for r in tuning.search(evolving, history, tuning.grid(spark, {"m": [100], "k": [50], "max_items": [1, 2]})).collect()}
    kept = sorted((r["SessionId"], r["position"], r["least"]) for r in tables["prefixes"].collect())
    assert kept == [(10, 1, 1), (12, 2, 2), (13, 2, 2), (13, 3, 1)]  # of 8
    for x in got:
        want = metrics.means(replay.predictions(evolving, history, replace(KnnParams(), m=100, k=50, n=20), x), 20).first()["mrr"]
        assert abs(got[x] - want) < 1e-9
    assert got[1] < got[2]


def test_a_search_with_full_lists_long_and_repeating_sessions_equals_replays(spark, monkeypatch):
    monkeypatch.setattr(tuning, "PACKED_CLICKS", 5)
    monkeypatch.setattr(tuning, "LISTED_AT_ONCE", 150)
    written = []
    monkeypatch.setattr(tuning, "stored", lambda df, name, f=tuning.stored: written.append(name) or f(df, name))
    rng = random.Random(8)
    past = [(s, rng.randrange(40), 100 * s + n) for s in range(50) for n in range(rng.randrange(1, 6))] + [(60 + s, 77, 9) for s in range(9)]
    now = [(s, rng.randrange(44), n) for s in range(30) for n in range(rng.randrange(1, 12))] + [(40, 77, 0), (40, 77, 1), (40, 3, 2)]
    history = spark.createDataFrame(past, "SessionId long, ItemId long, Time long")
    evolving = spark.createDataFrame(now, "eid long, item long, pos long")
    combos = tuning.grid(spark, {"m": [3, 5], "k": [2, 5], "max_items": [1, 3, 10]})
    got = {(r["m"], r["k"], r["max_items"]): r["mrr"] for r in tuning.search(evolving, history, combos, 5).collect()}
    assert len(got) == 9 and max(got.values()) > 0 and written.count("reachable") > 1
    for m, k, x in [(3, 2, 1), (5, 2, 3), (5, 5, 10)]:
        want = metrics.means(replay.predictions(evolving, history, replace(KnnParams(), m=m, k=k, n=5), x), 5).first()["mrr"]
        assert abs(got[m, k, x] - want) < 1e-9
