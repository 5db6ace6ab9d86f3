import math
import random

from clickloom.llm import mixing
from clickloom.llm.mixing import MixParams, mix_sources, mixed_corpus


def brute_targets(size, weights=(1, 2, 3), most=3):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, free = {}, sum(size.values()), list(order)
    while free:
        level = left / sum(w[s] for s in free)
        full = [s for s in free if level * w[s] > most * size[s]]
        if not full:
            out |= {s: level * w[s] for s in free}
            break
        for s in full:
            out[s] = most * size[s]
            left -= out[s]
            free.remove(s)
    return out


def rows_of(rng, n=400):
    sources = ["s0", "s1", "s2", "É", None, "tiny", "empty"]
    rows = [(i, "w " * rng.randint(0, 30), rng.choices(sources[:5], [30, 1, 5, 4, 3])[0]) for i in range(n)]
    return rows + [(n, "one", "tiny"), (n + 1, None, "empty"), (n + 2, "x y", None), (n + 2, "x y", None)]


def test_targets_and_taken_words(spark):
    rows = rows_of(random.Random(2))
    size: dict = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = brute_targets(size)
    docs = spark.createDataFrame([(i, t, s, 7) for i, t, s in rows], "doc_id long, text string, source string, size int")
    out = mix_sources(docs).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out)) == sorted(map(tuple, mix_sources(docs.repartition(7)).collect()))
    source = {i: s for i, _, s in rows}
    taken: dict = {}
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and math.isclose(r["target"], want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert math.isclose(sum(want.values()), sum(size.values()))


def test_corpus_holds_whole_rows_near_the_targets(spark):
    rows = rows_of(random.Random(5))
    docs = spark.createDataFrame([(i, t, s, i) for i, t, s in rows], "doc_id long, text string, source string, taken int")
    out = mixed_corpus(docs)
    assert out.columns == docs.columns
    size: dict = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    got: dict = {}
    for r in out.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    for s, target in brute_targets(size).items():
        assert abs(got.get(s, 0) - target) <= 30
    assert mixed_corpus(docs.limit(0)).count() == 0 and mix_sources(docs.limit(0)).count() == 0


def test_better_documents_are_taken_first(spark):
    good = [(i, "abcdef " * 20, "a") for i in range(300)]
    poor = [(300 + i, "x " * 20, "a") for i in range(300)]
    other = [(600 + i, "abcdef " * 20, "b") for i in range(600)]
    out = mix_sources(spark.createDataFrame(good + poor + other, "doc_id long, text string, source string"), MixParams(weights=(1, 3)))
    taken = {r["doc_id"]: r["taken"] for r in out.collect()}
    assert sum(taken[i] for i in range(300)) > 1.2 * sum(taken[i] for i in range(300, 600))


def test_no_bucket_holds_many_rows_of_any_weight(spark):
    for text in ("x x x x x x x x", "abcdef " * 8):  # of the least weight, and of about the largest
        docs = spark.range(40_000).selectExpr("id AS doc_id", f"'{text}' AS text", "'a' AS source")
        rows = mixing._rows(docs, MixParams(), [])
        most = rows.groupBy("__bucket").count().agg({"count": "max"}).first()[0]
        assert most < 3 * 5 * 40_000 / mixing.BUCKETS
