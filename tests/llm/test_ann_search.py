import numpy as np

from clickloom.llm.ann_search import AnnParams, best_places, encode, fit_codebooks, nearest


def brute(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            score = (x * x[n]).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if j != n][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def by_query(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = by_query(nearest(table, AnnParams(block=700, queries=30)))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    exact = {(q, i): s for q, own in want.items() for i, s in own}
    hits = sum((q, i) in exact for q, own in got.items() for i, _ in own)
    assert hits / len(exact) > 0.97
    assert all(abs(exact[q, i] - s) < 1e-9 for q, own in got.items() for i, s in own if (q, i) in exact)


def test_equal_vectors_tie_to_smaller_ids_and_unusable_ones_take_no_part(spark):
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(300)] + [(1000, [0.0, 0.0, 0.0]), (1020, None), (1040, [1.0, float("nan"), 0.0]), (1060, [1.0, None, 2.0]), (1080, [1.0]), (None, [9.0, 9.0, 9.0]), (2000, [-1.0, -1.0, -1.0])]
    got = by_query(nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")))
    assert set(got) == {*range(0, 300, 20), 2000}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[100]] == list(range(20))
    few = by_query(nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")))
    assert [i for i, _ in few[0]] == [1, 2]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_codes_lower_the_score_aware_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    p = AnnParams()
    books = fit_codebooks(x, p)
    loss = lambda c: sum(((r := x - np.concatenate([books[s, c[:, s]] for s in range(4)], 1)) ** 2).sum(1) + (p.eta - 1) * ((r * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2)
    plain = ((x.reshape(-1, 4, 2)[:, :, None] - books[None]) ** 2).sum(3).argmin(2)
    assert loss(encode(x, books, p)) < loss(plain)
    assert best_places(np.array([1.0, 3, 2, 2, 2]), 3).tolist() == [1, 2, 3]
