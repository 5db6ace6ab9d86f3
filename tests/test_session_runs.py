import random
from datetime import datetime, timedelta
from itertools import groupby

import __spark_entry__ as entry
from clickloom.sources import readers


def brute(rows):
    out = []
    for session, run in groupby(enumerate(sorted(rows), 1), key=lambda r: r[1][1]):
        own = list(run)
        out.append((session, own[0][0], [item for _, (_, _, item) in own]))
    return sorted(out, key=lambda r: r[1])


def test_runs_across_blocks_equal_brute_force(spark):
    rng = random.Random(1)
    for sessions in (1, 2, 40):  # one session is one run through all blocks
        rows = [(n, rng.randrange(sessions), rng.randrange(9)) for n in range(700)]
        df = spark.createDataFrame(rows, "at long, SessionId long, ItemId long").repartition(5)
        runs = readers.runs_of_sessions(df, "at")
        assert sorted(((r["SessionId"], r["run"], r["items"]) for r in runs.collect()), key=lambda r: r[1]) == brute(rows)


def test_query_has_the_runs_of_all_sessions(spark, tmp_path):
    day = datetime(2024, 1, 1)
    lines = [(s, s % 7, n, day + timedelta(days=n)) for s in (5, 1999, 2000, 70001) for n in range(1, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted((r["run"], r["SessionId"], r["items"]) for r in entry.queries()["session_runs"](spark, str(tmp_path)).collect())
    order = sorted((t, s, n, item) for s, item, n, t in lines)
    assert got == [(i, s, str(item)) for i, (_, s, _, item) in enumerate(order, 1)]
