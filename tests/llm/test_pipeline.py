import corpus_pipeline
from clickloom.llm import mixing
from clickloom.session import stored


def test_stages_in_order_and_their_decisions_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "mix_sources", "best_fit_packing"]
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(stored(stage(spark, held[-1], sf), "test-stage"))
        if len(held) < 6:
            assert held[-1].columns == docs.columns
    n = [h.count() for h in held]
    assert n[0] > n[1] > n[2] > n[3]
    assert held[2].select("text").distinct().count() == n[2]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in held[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.98 * len(good)
    ids = sorted(r["doc_id"] for r in held[4].collect())
    assert sorted({r["doc_id"] for r in held[5].collect()}) == sorted(set(ids))
    assert held[5].filter("piece = 0").count() == len(ids)
    tokens = held[3].select(mixing.n_tokens(held[3]["text"]).alias("n")).agg({"n": "sum"}).first()[0]
    mixed = held[4].select(mixing.n_tokens(held[4]["text"]).alias("n")).agg({"n": "sum"}).first()[0]
    assert abs(mixed - tokens) < 0.05 * tokens
