from clickloom.llm import quality


def test_what_training_needed_is_given_back(spark, monkeypatch):
    done = []
    monkeypatch.setattr(quality, "train", lambda *a, f=quality.train: done.append("train") or f(*a))
    monkeypatch.setattr(quality, "release", lambda: done.append("release"), raising=False)
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    quality.score_quality(docs, labels, quality.QualityParams(steps=5))
    assert done == ["train", "release"]
