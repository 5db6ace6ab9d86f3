from clickloom.plans import registry
from clickloom.streaming.state import evolve_batch, step

SF = "/root/testdata/sf0.001"


def test_steps():
    assert step([], None, 1, 0, 1200, 2) == [1]
    assert step([1], 0, 2, 1200, 1200, 2) == [1, 2]
    assert step([1, 2], 0, 2, 5, 1200, 2) == [1, 2]
    assert step([1, 2], 0, 3, 5, 1200, 2) == [2, 3]
    assert step([1, 2], 0, 3, 1201, 1200, 2) == [3]


def test_stream_equals_batch_and_the_fold(spark):
    batch = sorted(map(tuple, registry.session_state_batch(spark, SF).collect()))
    assert batch == sorted(map(tuple, registry.session_state_stream(spark, SF).collect()))
    requests = registry._requests(spark, SF).collect()
    held, want = {}, {}
    for r in sorted(requests, key=lambda r: (r["time"], r["request_id"])):
        if not r["user_consent"]:
            want[r["request_id"]] = [r["item_id"]]
            continue
        items, last = held.get(r["session_id"], ([], None))
        held[r["session_id"]] = (step(items, last, r["item_id"], r["time"], 43200, 4), r["time"])
        want[r["request_id"]] = held[r["session_id"]][0]
    assert {i: [int(x) for x in items.split(",")] for _, i, items in batch} == want


def test_boundaries_of_idleness_and_consent(spark):
    rows = [(1, "a", 1, 0, True), (2, "a", 2, 1200, True), (3, "a", 3, 2401, True), (4, "a", 9, 2402, False)]
    df = spark.createDataFrame(rows, "request_id long, session_id string, item_id long, time long, user_consent boolean")
    assert {r["request_id"]: r["items"] for r in evolve_batch(df).collect()} == {1: [1], 2: [1, 2], 3: [3], 4: [9]}


def test_incremental_view_equals_batch(spark):
    key = ["eid", "rank", "item", "score"]
    got = registry.QUERIES["incremental_stream"](spark, SF).select(key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, registry.QUERIES["recommend_serving"](spark, SF).select(key).collect()))
