import math
import zlib
from collections import Counter

import numpy as np

from clickloom.llm import maxent_lm as lm


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    said = [lm.tokens((t or "").encode()) for _, t in rows]
    c = Counter(w for h, s in zip(held, said, strict=True) if not h for w in s)
    n, v = sum(c.values()), len(c)
    return [(h, len(s), sum(w in c for w in s), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s)) for h, s in zip(held, said, strict=True)]


def test_base_scores_equal_brute_force_and_the_model_is_better_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = dict(zip([i for i, _ in rows], brute(rows), strict=True))
    small = lm.LmParams(frequent=2000)  # so that many words are joined
    got = {r["doc_id"]: r for r in lm.score_documents(docs, small).collect()}
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.97 * sum(r["base_score"] for r in out)
    full = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    assert sum(full[r["doc_id"]] for r in out) > sum(r["base_score"] for r in out)


def test_probabilities_of_all_words_and_the_unknown_one_sum_to_one(spark):
    docs = spark.createDataFrame([(i, f"the cat sat on mat{i} the dog") for i in range(40)], "doc_id long, text string")
    p = lm.LmParams(frequent=10)
    counts = lm.token_counts(docs, p)
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    v = lm.vocabulary(counts, p)
    w = lm.train(docs, v, p)
    rows, before = lm._features([lm._digits(b"the cat", v, p)[2]], p)
    total, half = 0.0, p.leaves // 2
    leaves = np.arange(p.leaves)
    leaf = 10 ** lm._log_probability(w, np.repeat(rows[1:2], p.leaves, 0), np.repeat(before[1:2], p.leaves), leaves, p)
    assert abs(leaf.sum() - 1) < 1e-4
    for x in range(half, p.leaves):
        own = [n for word, n in c.items() if v.number.get(word, half) >= half and half + zlib.crc32(word[:3]) % (p.leaves - half) == x]
        inside = sum((n + 0.5) / 10 ** v.denominator[x] for n in own) + 0.5 / 10 ** v.denominator[x]
        assert abs(inside - 1) < 1e-9
        total += leaf[x]
    assert total < 1


def test_nulls_empty_texts_repeats_and_empty_tables(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "a " * 5000), (4, "A\x0bb\xa0c")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.score_documents(docs).collect())
    want = sorted((i or 0, h, n, k, t, round(b, 6)) for (i, _), (h, n, k, t, b) in zip(rows, brute(rows), strict=True))
    assert got == want
    assert lm.score_documents(docs.limit(0)).count() == 0
    assert lm.score_documents(docs.filter("doc_id = 2")).count() == 1


def test_two_merging_steps_give_the_weights_of_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6, "doc_id")
    weights = []
    for fan_in in (1, 2, 100):
        p = lm.LmParams(frequent=2000, fan_in=fan_in)
        weights.append(lm.train(docs, lm.vocabulary(lm.token_counts(docs, p), p), p))
    for w in weights[1:]:
        np.testing.assert_allclose(w.outer, weights[0].outer, atol=1e-5)
        np.testing.assert_allclose(w.inner, weights[0].inner, atol=1e-5)
    assert np.abs(weights[0].outer).sum() > 0
