import pytest

from clickloom.plans import models, replay, tuning
from clickloom.sources import readers, sinks


def test_click_files(spark, tmp_path):
    path = tmp_path / "clicks.tsv"
    path.write_text("SessionId\tItemId\tTime\n1\t10\t100.5\n1\tbad\t7\n2\t20\t101.5\n")
    assert sorted(map(tuple, readers.read_clicks(spark, str(path)).collect())) == [(1, 10, 101), (2, 20, 102)]
    assert sorted(map(tuple, readers.read_clicks(spark, str(path), half_even=True).collect())) == [(1, 10, 100), (2, 20, 102)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        readers.read_clicks(spark, str(path), strict=True).collect()
    parts = [readers.read_clicks_partition(spark, str(path), i, 3).count() for i in range(3)]
    assert sum(parts) == 2


def test_predictions_latencies_and_json(spark, tmp_path):
    df = spark.createDataFrame([(list(range(30)), [5, 6]), ([], [1])], "recs array<long>, next_items array<long>")
    sinks.write_predictions(df, str(tmp_path / "p"))
    rows = sorted(readers.read_predictions(spark, str(tmp_path / "p")).collect(), key=lambda r: len(r["recs"]))
    assert rows[0]["recs"] == [] and rows[1]["recs"] == list(range(20)) and rows[1]["next_items"] == [5, 6]
    scored = readers.synthetic_scores(readers.read_predictions(spark, str(tmp_path / "p"))).orderBy("rank").collect()
    assert [r["score"] for r in scored[:3]] == [1.0, 0.999, 0.998]
    times = spark.createDataFrame([(i, 10 * i) for i in range(1, 11)], "position int, latency_in_micros long")
    sinks.write_latencies(times, str(tmp_path / "l"))
    assert spark.read.option("header", True).csv(str(tmp_path / "l")).count() == 10
    row = sinks.latency_summary(times).first()
    assert row["fastest_90"] == 50.0 and row["most"] == 100
    recs = spark.createDataFrame([(1, 2, 8), (1, 1, 9)], "eid long, rank int, item long")
    assert sinks.json_responses(recs).first()["body"] == "[9,8]"
    assert "<td>n</td><td>1</td>" in sinks.stats_page(spark.createDataFrame([(1,)], "n int"))


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "c.toml").write_text('[hyper]\nneighborhood_size_k = 7\n[data]\ntraining_data_path = "a"\n')
    monkeypatch.setenv("TRAINING_DATA", '"b"')
    s = readers.read_settings(str(tmp_path / "c.toml"))
    assert (s.neighborhood_size_k, s.training_data_path, s.m_most_recent_sessions, s.num_items_to_recommend) == (7, "b", 500, 21)


def test_runs_and_prefixes(spark):
    df = spark.createDataFrame([(n, s, n) for n, s in enumerate([1, 1, 2, 1, 2, 2])], "at long, SessionId long, ItemId long")
    runs = sorted((r["run"], r["SessionId"], r["items"]) for r in readers.runs_of_sessions(df, "at").collect())
    assert [r[1:] for r in runs] == [(1, [0, 1]), (2, [2]), (1, [3]), (2, [4, 5])]
    e = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 5, 1)], "eid long, item long, pos long")
    got = sorted((r["position"], r["history"], r["next_items"]) for r in replay.prefixes(e, 1).collect())
    assert got == [(1, [10], [11, 12]), (2, [11], [12])]


def test_grids_and_index_days(spark, tmp_path):
    values = {n: list(range(5)) for n in "abc"}
    assert tuning.combinations(values) == 125 == tuning.grid(spark, values).count()
    assert tuning.random_combinations(spark, values, 10).distinct().count() == 10
    assert tuning.random_combinations(spark, {"a": [1000], "b": [500], "c": [10]}, 10).count() == 1
    rows = [(f"v{b}", (b * 7 + n * 60) * 1000, n % 4, 1, n % 2, 0) for b in range(8) for n in range(12)]
    df = spark.createDataFrame(rows, "bui string, timestamp long, item_id long, qty_detailpage int, qty_purchased int, qty_add_to_cart int")
    for day in ("2024-01-01", "2024-01-02"):
        df.write.parquet(str(tmp_path / day))
    events = readers.read_days(spark, str(tmp_path), "2024-01-02", 1)
    assert events.count() == 2 * len(rows)
    items, sessions = models.build_indexes(events, None, gap=3600)
    assert items.count() == 4 and {len(r["item_ids_asc"]) for r in sessions.collect()} == {4}
    sinks.write_index(items, sessions, str(tmp_path / "index"), files=2)
    assert [x.count() for x in readers.read_index(spark, str(tmp_path / "index"))] == [4, 8]


def test_events_by_column_name_with_a_limit_and_counts(spark, tmp_path):
    path = str(tmp_path / "events.tsv")
    with open(path, "w") as f:
        f.write("Time\tItemId\tSessionId\textra\n30\t1\t7\tx\n10\t2\t8\ty\n20\t3\t7\tz\n")
    assert sorted(map(tuple, readers.first_events(spark, path).collect())) == [(7, 1, 30), (7, 3, 20), (8, 2, 10)]
    assert sorted(map(tuple, readers.first_events(spark, path, 2).collect())) == [(7, 3, 20), (8, 2, 10)]
    spark.range(17).write.parquet(str(tmp_path / "many"))
    assert readers.count_rows(spark, str(tmp_path / "many")) == 17
