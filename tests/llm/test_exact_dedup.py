import hashlib

import pytest
from pyspark.sql import functions as F

from clickloom.llm import exact_dedup
from clickloom.llm.exact_dedup import DigestIndex, dedup_exact, keep_one_of_each, text_digests

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (6, "A"), (7, "a "), (2, "a"), (None, "a"), (None, "z")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_equals_brute_force(spark, keep):
    docs = spark.createDataFrame([(i, t, True) for i, t in ROWS], "doc_id long, text string, kept boolean")
    groups: dict = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    pick = min if keep == "smallest" else max
    got = dedup_exact(docs, keep).collect()
    assert len(got) == len(ROWS)
    kept: dict = {}
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["keep_id"] == (pick(ids) if ids else None) and r["group_size"] == len(groups[text])
        kept[text] = kept.get(text, 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_stage_keeps_one_row_of_each_text_with_all_columns(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, digest string")
    out = keep_one_of_each(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r["text"] or "" for r in rows) == sorted({t or "" for _, t in ROWS})
    assert keep_one_of_each(docs.limit(0)).count() == 0


def test_runs_merge_and_heavy_groups_are_verified_in_parts(spark, monkeypatch):
    index = DigestIndex(spark, "smallest")
    for lo in (0, 50):
        index.flush(text_digests(spark.range(lo, lo + 60).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS text")))
    rows = index.compact().collect()
    assert len(rows) == 7 and sum(r["group_size"] for r in rows) == 120 and len(index.runs) == 1
    monkeypatch.setattr(exact_dedup, "VERIFY_ROWS", 50)
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', cast(id AS string)) AS text")
    out = dedup_exact(docs, "largest").collect()
    assert sum(r["kept"] for r in out) == 2001 and {r["keep_id"] for r in out if r["group_size"] == 1000} == {2997}


def test_lookup_reads_the_shards_of_the_digests_alone(spark):
    index = DigestIndex(spark, "smallest")
    for lo in (0, 500):
        index.flush(text_digests(spark.range(lo, lo + 600).selectExpr("id AS doc_id", "cast(id % 900 AS string) AS text")))
    asked = [hashlib.sha256(t).digest() for t in (b"7", b"550", b"899", b"none")]
    for _ in range(2):
        got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in index.lookup(asked).collect()}
        assert got == {asked[0]: (7, 2), asked[1]: (550, 2), asked[2]: (899, 1)}
        plan = index.lookup(asked[:1])._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(shard" in plan and "PushedFilters: [IsNotNull(digest), EqualTo(digest" in plan.replace("In(digest", "EqualTo(digest")
        whole, read = (sum(files(spark, run, shard) for run in index.runs) for shard in (None, asked[0][0] // 16))
        assert 0 < read < whole / 4
        index.compact()
    many = [hashlib.sha256(str(i).encode()).digest() for i in range(25)]
    assert index.lookup(many).count() == 25 and index.lookup([]).count() == 0


def files(spark, run, shard):
    """How many files a scan of the run, or of one shard of it, reads."""
    rows = run if shard is None else run.filter(f"shard = {shard}")
    return rows.select(F.input_file_name()).distinct().count()


def test_a_task_writes_to_few_folders_of_a_run(spark):
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = exact_dedup.DigestIndex(spark)
        for g in range(2):
            index.flush(exact_dedup.text_digests(spark.range(g * 2000, g * 2000 + 4000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")))
        merged = index.compact()
        assert merged.count() == 6000 and merged.filter("group_size = 2").count() == 2000
        assert len(index.runs[0].inputFiles()) <= 40 + exact_dedup.SHARDS
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
