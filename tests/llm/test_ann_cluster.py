import numpy as np
import pytest

from clickloom.llm.ann_search import AnnParams, nearest


@pytest.mark.parametrize("noise", [0.001, 0.05])
def test_recall_in_a_cluster_of_a_third_of_the_rows(spark, noise):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x[::3] = rng.normal(size=64) + noise * rng.normal(size=(2000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nearest(df, AnnParams()).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for i in range(0, 6000, 60):  # queries in the cluster
        score = (x * x[i]).sum(1)
        score[i] = -np.inf
        hits.append(len(got[i] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.99
