import random

from clickloom.llm import near_dup
from clickloom.llm.near_dup import NearDupParams, components, keep_one_of_each_group, least_matches, near_duplicates


def shingles(text, size):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(rng, n=160):
    words = [f"W{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            t = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.choice([0, 1, 1, 2, 3, 30, 60, 90]))]
        rows.append((i, " ".join(t)))
    return rows


def test_equals_brute_force(spark):
    for size, seed in ((2, 1), (5, 2)):
        rows = corpus(random.Random(seed))
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, NearDupParams(words=size)).collect()}
        assert got == brute(rows, size)


def test_the_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, NearDupParams(words=2)).collect()}
    assert got == brute(rows, 2)


def test_chains_whose_ends_differ_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near_dup, "HUB_ROWS", 4)
    words = [f"w{i}" for i in range(200)]
    rows = [(1000 - i, " ".join(words[3 * i : 3 * i + 60])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, NearDupParams(words=2)).collect()}
    assert got == brute(rows, 2)
    assert len({c for _, c in got.values()}) == 1


def test_a_bucket_compares_its_largest_component_with_the_others_only(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    sizes = [(7, i, 100, "main") for i in range(21)] + [(7, 100 + i, 200 + i, "other") for i in range(6)]
    rows = spark.createDataFrame([(b, i, label, 100, 6, 2) for b, i, label, _ in sizes], "band long, id long, label long, main long, main_parts int, other_parts int")
    cells = near_dup._block_pairs(rows).collect()
    met = {}
    for r in cells:
        met.setdefault((r["low"], r["high"]), []).append((r["block"], r["id"], r["label"]))
    pairs = {tuple(sorted((a[1], b[1]))) for (low, high), own in met.items() for a in own for b in own if a[1] < b[1] and a[2] != b[2] and (low == high or a[0] != b[0])}
    assert pairs == {tuple(sorted((a[1], b[1]))) for a in sizes for b in sizes if a[1] < b[1] and a[2] != b[2]}
    assert len(cells) == 21 * 2 + 6 * 8


def test_nulls_repeated_ids_ties_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, text.upper()), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "ONE"), (None, text), (8, "b c"), (8, "b c d"), (8, "b c")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), NearDupParams(words=2)).collect()
    assert len(out) == len(rows)
    at = {r["doc_id"]: r for r in out}
    assert (at[2]["component_id"], at[2]["kept"], at[7]["component_id"], at[6]["n_shingles"]) == (1, False, 6, 1)
    assert all(at[i]["kept"] and at[i]["n_shingles"] == 0 for i in (3, 4, 5))
    assert at[None]["component_id"] == 1 and not at[None]["kept"]
    eights = [r for r in out if r["doc_id"] == 8]  # "b c" twice, and "b c d", which isn't alike
    assert sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in eights) == [(1, 8, False), (1, 8, True), (2, 8, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = keep_one_of_each_group(docs, NearDupParams(words=2))
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted([text, "", "", " \t\n", "one", "b c", "b c d"])
    assert near_duplicates(docs.limit(0)).count() == 0


def test_rows_without_ids_link_through_each_other(spark):
    words = [f"w{i}" for i in range(70)]
    rows = [(None, " ".join(words[:60])), (None, " ".join(words[3:63])), (4, " ".join(words[6:66])), (4, "else entirely"), (None, "alone here")]
    out = near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int"), NearDupParams(words=2)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out) == [(0, 0, True), (0, 4, False), (0, 4, False), (4, 4, True), (4, 4, True)]


def test_very_long_texts_and_a_hub_of_a_third_of_all(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-50], "x"])), (3, " ".join(reversed(long)))]
    near = [f"v{i}" for i in range(80)]
    rows += [(100 + i, " ".join([*near, f"own{i}"])) for i in range(400)] + [(1000 + i, " ".join(f"u{i * 50 + k}" for k in range(40))) for i in range(600)]
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2] == 1 and out[3] == 3
    assert {out[100 + i] for i in range(400)} == {100} and all(out[1000 + i] == 1000 + i for i in range(600))


def test_bounds_and_components(spark):
    steps = least_matches(NearDupParams())
    assert [n for n, _ in steps] == [32, 64, 96, 128] and all(m < 0.8 * n for n, m in steps)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 49), (51, 50)], "hub long, id long")
    got = {r["id"]: r["label"] for r in components(edges, "test").collect()}
    assert got == {**{i: 0 for i in range(31)}, 49: 49, 50: 49, 51: 49}
