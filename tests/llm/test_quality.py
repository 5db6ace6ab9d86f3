import math
import zlib

from clickloom.llm.quality import QualityParams, accepted, features, score_quality, train, training_rows


def test_held_out_accuracy_and_reproducible_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = score_quality(docs, labels).collect()
    mark = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = [r for r in rows if r["held_out"] and r["doc_id"] in mark]
    assert len(rows) == docs.count() and len(out) > 500
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    right = sum(r["predicted"] == mark[r["doc_id"]] for r in out) / len(out)
    bad = [r for r in out if mark[r["doc_id"]] == 0]
    good = [r for r in out if mark[r["doc_id"]] == 1]
    assert right > 0.97
    assert sum(r["predicted"] == 0 for r in bad) > 0.85 * len(bad)
    assert sum(r["predicted"] == 1 for r in good) > 0.98 * len(good)


def test_nulls_empty_long_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "", 1.0), (2, None, 2.0), (None, "a b", 3.0), (3, "word " * 50_000, 4.0), (3, "word", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = score_quality(docs, labels, QualityParams(steps=5)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (1, 2)} == {rows[0]["score"]}
    kept = accepted(docs, labels, QualityParams(threshold=0.0))
    assert kept.columns == docs.columns and kept.count() == 5
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


def test_labels_without_a_text_here_take_no_place_in_the_sample(spark):
    good, bad = "a calm and even text of the usual kind ", "spam spam !!! click $$$ "
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) * 5) for i in range(9000, 9100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9100)], "doc_id long, quality int")
    p = QualityParams(train_docs=60, steps=200)
    texts, marks = training_rows(docs, labels, p)
    assert len(texts) == len(marks) == 60 and set(marks) == {0, 1}
    got = score_quality(docs, labels, p).collect()
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got)
    assert sum(map(len, training_rows(docs, labels, QualityParams(train_chars=1000))[0])) <= 1000


def test_scores_equal_the_average_of_vectors_worked_out_plainly(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 11}" for k in range(i % 9)), i % 2) for i in range(1, 60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    p = QualityParams(steps=40)
    weights, bias = train(*training_rows(docs, labels, p), p)
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, labels, p).collect()}
    for i, text, _ in rows:
        ids = next(features([text.encode()], p))[1]
        odds = bias + (sum(float(weights[k]) for k in ids) / len(ids) if len(ids) else 0.0)
        assert math.isclose(got[i], 1 / (1 + math.exp(-odds)), rel_tol=1e-6)
