import random
import time

import pytest
from pyspark.sql import functions as F

from clickloom.llm import line_dedup
from clickloom.llm.line_dedup import LineDedupParams, dedup_lines
from clickloom.llm.rows import numbered


def brute(rows, least):
    """Marks every line of every common run, by comparing all pairs of positions."""
    flat = [(i, n, line) for i, t in sorted(rows) for n, line in enumerate((t or "").split("\n")) if line.split()]
    gone = set()
    for b in range(len(flat)):
        for a in range(b):
            k, size = 0, 0
            while b + k < len(flat) and flat[a + k][2] == flat[b + k][2] and flat[a + k][0] == flat[a][0] and flat[b + k][0] == flat[b][0]:
                size += len(flat[b + k][2].split())
                k += 1
            if size >= least:
                gone |= {flat[b + j][:2] for j in range(k)}
    return gone


def got(df):
    return {(r["doc_id"], int(n)) for r in df.collect() for n in r["removed"].split(",") if n}


def test_equals_brute_force_on_random_lines(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 4))) for _ in range(9)]
    for least in (1, 5, 9):
        rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(25)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(dedup_lines(docs, LineDedupParams(words=least))) == brute(rows, least)


def test_a_passage_is_kept_once_and_the_rest_is_whole(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a b\n{passage}\nc"), (2, f"{passage}\n\nd e"), (3, "x y z"), (4, f"q\n{passage}")]
    out = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i]["clean_text"] for i in (1, 2, 3, 4)] == [rows[0][1], "\nd e", "x y z", "q"]
    assert out[2]["removed"] == "0" and out[1]["n_removed"] == 0


def test_nulls_repeated_ids_and_empty_tables(spark):
    long = " ".join("w" for _ in range(80))
    rows = [(None, long), (None, long), (5, long), (5, long), (6, None), (7, ""), (None, "own"), (None, None)]
    out = dedup_lines(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, gone int")).collect()
    assert len(out) == len(rows)
    # Of the four copies, one with the smallest doc_id stays; rows without an id come last.
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 0), (0, 0), (0, 1), (0, 1), (5, 0), (5, 1), (6, 0), (7, 0)]
    assert sorted(r["clean_text"] for r in out) == sorted(["", "", "", "", "", "", "own", long])
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_ids_equal_brute_force(spark):
    rng = random.Random(8)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(7)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))) for _ in range(20)]
    docs = spark.createDataFrame([(rng.choice([1, 2, 3, None]), t) for t in dict.fromkeys(texts)], "doc_id long, text string")
    order = [r["text"] for r in numbered(docs, "row").orderBy("row").collect()]
    want = brute(list(enumerate(order)), 6)
    clean = ["\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in want) for i, text in enumerate(order)]
    got = [(r["clean_text"], r["n_removed"]) for r in dedup_lines(docs, LineDedupParams(words=6)).collect()]
    assert sorted(got) == sorted((t, sum(k == i for k, _ in want)) for i, t in enumerate(clean))


def test_longest_earlier_prefixes_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))) for i in range(12)]
    p = LineDedupParams(words=16)
    active = line_dedup._active(line_dedup._lines(numbered(spark.createDataFrame(rows, "doc_id long, text string"), "row")), LineDedupParams(words=1))
    levels = line_dedup.suffix_levels(active, p)
    at = {r["pos"]: (bytes(r["id"]), r["left"]) for r in active.collect()}

    def common(i, j):
        n = 0
        while n < min(at[i][1], at[j][1]) and at[i + n][0] == at[j + n][0]:
            n += 1
        return n

    want = {i: min(16, max((common(i, j) for j in at if j < i), default=0)) for i in at}
    assert {r["pos"]: r["length"] for r in line_dedup.earlier_prefixes(levels).collect()} == {i: n for i, n in want.items() if n}
    for k, level in enumerate(levels):  # ranks follow the order of the suffixes
        held = sorted((r["rank"], [at[r["pos"] + d][0] for d in range(1 << k)]) for r in level.collect())
        assert len({r for r, _ in held}) == len({tuple(x) for _, x in held})
        assert k or [x for _, x in held] == sorted(x for _, x in held)


def test_long_documents_and_a_line_of_a_third_of_all_take_seconds(spark):
    long = [f"line {i} of the book" if i % 3 else "---" for i in range(100_000)]
    copied = long[:2000]
    rows = [(1, "\n".join(long)), (2, "x\n" + "\n".join(copied) + "\ny")]
    began = time.time()
    out = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert out[1]["n_removed"] == 0 and out[1]["clean_text"] == rows[0][1]
    assert out[2]["n_removed"] == 2000 and out[2]["clean_text"] == "x\ny"
    out = dedup_lines(spark.createDataFrame([(1, "\n".join(["same words in each line"] * 60_000 + ["end"]))], "doc_id long, text string")).first()
    assert out["clean_text"].split("\n")[-1] == "end" and out["n_removed"] == 59_999


def test_different_lines_of_one_digest_stop_the_job(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_digest", lambda line: F.substring(line, 1, 3).cast("binary"))
    docs = spark.createDataFrame([(1, "abc one"), (2, "abc two")], "doc_id long, text string")
    with pytest.raises(RuntimeError):
        dedup_lines(docs, LineDedupParams(words=2)).collect()
