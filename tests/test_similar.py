import random
from itertools import combinations
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from clickloom.functions.weights import similarity
from clickloom.operators import similar

KINDS = ["jaccard", "tanimoto", "cosine", "cosine_legacy", "binary"]


def brute(spark, rows, kind):
    sets = {}
    for s, i in rows:
        if s is not None and i is not None:
            sets.setdefault(s, set()).add(i)
    pairs = [(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for x in combinations(sets, 2) for a, b in (x, x[::-1]) if sets[a] & sets[b]]
    df = spark.createDataFrame(pairs, "eid long, sid long, c long, l long, r long").withColumn("s", similarity(kind, F.col("c"), F.col("l"), F.col("r")))
    return {r["eid"]: tuple(r)[1:] for r in df.groupBy("eid").agg(F.count("*"), F.sum("s"), F.max("s")).collect()}


def clicks_of(seed):
    rng = random.Random(seed)
    rows = [(s, rng.randrange(40)) for s in range(60) for _ in range(rng.randrange(1, 8))]
    rows += [(s, 1) for s in range(100, 160)]  # a common item
    rows += [(s, i) for s in (200, 201, 202) for i in (50, 51, 52)]  # copies
    rows += [(300 + s, i) for s in range(3) for i in range(s, 90)]  # longer than LONG
    return rows + [(400, 999), (None, 1), (401, None), (None, None), (0, None)]


@pytest.mark.parametrize("kind", KINDS)
def test_sums_equal_those_over_all_pairs(spark, kind, monkeypatch):
    rows = clicks_of(KINDS.index(kind))
    want = brute(spark, rows, kind)
    for pairs in (similar.BROADCAST_PAIRS, 0):
        monkeypatch.setattr(similar, "BROADCAST_PAIRS", pairs)
        got = {r["eid"]: tuple(r)[1:] for r in similar.similar_sessions(spark.createDataFrame(rows, "SessionId long, ItemId long"), kind).collect()}
        assert set(got) == set(want)
        for s, (n, total, most) in want.items():
            assert got[s][0] == n and got[s][1] == pytest.approx(total) and got[s][2] == pytest.approx(most)


def test_a_common_item_gives_no_row_for_each_pair(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(similar, "stored", lambda df, name, f=similar.stored: written.setdefault(name, f(df, name)))
    rows = [(s, i) for s in range(3000) for i in (0, 1 + s)]
    got = similar.similar_sessions(spark.createDataFrame(rows, "SessionId long, ItemId long"), "jaccard").collect()
    assert len(got) == 3000 and all(r["n"] == 2999 for r in got)
    assert sum(t.count() for t in written.values()) < 4 * 3000


@pytest.mark.parametrize("kind", KINDS)
def test_copies_of_sessions_weigh_as_many_without_a_row_for_each_pair(spark, kind, monkeypatch):
    written = {}
    monkeypatch.setattr(similar, "stored", lambda df, name, f=similar.stored: written.setdefault(name, f(df, name)))
    rows = [(10 * s + k, i) for s, items in enumerate(((1, 2, 3), (1, 2, 4), (3,), (5, 6), tuple(range(70)))) for k in range(6 + s) for i in items]
    want = brute(spark, rows, kind)
    got = {r["eid"]: tuple(r)[1:] for r in similar.similar_sessions(spark.createDataFrame(rows, "SessionId long, ItemId long"), kind).collect()}
    assert set(got) == set(want)
    for s, (n, total, most) in want.items():
        assert got[s][0] == n and got[s][1] == pytest.approx(total) and got[s][2] == pytest.approx(most)
    assert written["pairs"].count() == 4  # of classes, where sessions would give hundreds


@pytest.mark.parametrize("kind", ["jaccard", "cosine_legacy"])
def test_parts_give_the_same_sums_and_leave_no_table_that_none_reads(spark, kind, monkeypatch):
    monkeypatch.setattr(similar, "PART_ITEMS", 50)
    gone = []
    monkeypatch.setattr(similar, "discard", lambda table, f=similar.discard: gone.append((table.inputFiles()[0], f(table))))
    rows = clicks_of(7)
    want = brute(spark, rows, kind)
    got = {r["eid"]: tuple(r)[1:] for r in similar.similar_sessions(spark.createDataFrame(rows, "SessionId long, ItemId long"), kind).collect()}
    assert set(got) == set(want)
    for s, (n, total, most) in want.items():
        assert got[s][0] == n and got[s][1] == pytest.approx(total) and got[s][2] == pytest.approx(most)
    assert len(gone) == 2 and not any(Path(unquote(urlparse(f).path)).parent.exists() for f, _ in gone)


@pytest.mark.parametrize("length", [5, similar.LONG + 1])
def test_short_sessions_are_shuffled_neither_for_long_ones_nor_for_copies(spark, length, monkeypatch):
    plans = {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(similar, "stored", lambda df, name, f=similar.stored: (plans.setdefault(name, plan(df)), f(df, name))[1])
    rows = [(s, i) for s in range(40) for i in (s % 7, 7 + s % 5)] + [(50, i) for i in range(length)]
    want = brute(spark, rows, "binary")
    found = similar.similar_sessions(spark.createDataFrame(rows, "SessionId long, ItemId long"), "binary")
    got = {r["eid"]: tuple(r)[1:] for r in found.collect()}
    assert set(got) == set(want)
    for s, (n, total, most) in want.items():
        assert got[s][0] == n and got[s][1] == pytest.approx(total) and got[s][2] == pytest.approx(most)
    assert "Exchange hashpartitioning(item" not in plans["pairs"] and ("Generate" in plans["pairs"]) == (length > similar.LONG)
    assert "Exchange hashpartitioning" not in plan(found)


@pytest.mark.parametrize("kind", ["binary", "cosine_legacy"])
def test_a_part_of_the_classes_goes_when_its_sums_are_written(spark, kind, monkeypatch):
    monkeypatch.setattr(similar, "PART_ITEMS", 50)
    exists = lambda f: Path(unquote(urlparse(f).path)).parent.exists()
    files, left = {}, []

    def noted(df, name, *rest, f):
        out = f(df, name, *rest)
        files[name] = out.inputFiles()[0]
        left.append(sum(exists(x) for n, x in files.items() if n.startswith("item-classes")) if name.startswith("shared-once") else None)
        return out

    for maker in ("stored", "moved"):
        monkeypatch.setattr(similar, maker, lambda *a, f=getattr(similar, maker, None): noted(*a, f=f), raising=False)
    rows = clicks_of(8)
    want = brute(spark, rows, kind)
    got = {r["eid"]: tuple(r)[1:] for r in similar.similar_sessions(spark.createDataFrame(rows, "SessionId long, ItemId long"), kind).collect()}
    assert set(got) == set(want)
    for s, (n, total, most) in want.items():
        assert got[s][0] == n and got[s][1] == pytest.approx(total) and got[s][2] == pytest.approx(most)
    assert [x for x in left if x is not None] == list(reversed(range(similar.PARTS)))


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    import time

    from clickloom.session import stored

    size = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = size()
    stored(spark.range(1000).repartition(4, "id"), "a-table")
    for _ in range(50):
        if size() <= before:
            break
        time.sleep(0.1)
    assert size() <= before
