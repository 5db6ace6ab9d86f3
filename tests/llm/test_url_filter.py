import random

from pyspark.sql import functions as F

from clickloom.llm import url_filter
from clickloom.llm.url_filter import RULES, judge_urls, rule_frame


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_equals_brute_force_on_nested_rules(spark):
    rng = random.Random(8)
    labels, dirs = ["a", "b", "com", "net", "ab"], ["", "/", "/x", "/x/", "/x/y", "/xy/z", "/y"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({(host(), rng.choice(dirs)) for _ in range(60)})
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in rules]
    urls = [f"http://{host()}{rng.choice(dirs)}{rng.choice(['', '?q=/x', '#f', 'z'])}" for _ in range(800)]
    urls += [None, "", "no url", "://", "http://", "HTTP://A.Com?x", "x://É.com/X", "a://b://c/x"]
    pages = spark.createDataFrame([(i % 500, u, 1) for i, u in enumerate(urls)] + [(None, urls[0], 2)] * 3, "page_id long, url string, verdict int")
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in judge_urls(pages, rule_frame(spark, rules)).collect())
    want = sorted((str(i), *(str(x) if n == 2 else x for n, x in enumerate(brute(u, rules)))) for i, u in [(r["page_id"], r["url"]) for r in pages.collect()])
    assert got == want


def test_production_rules_hot_urls_and_empty_tables(spark):
    pages = spark.createDataFrame([(i, "http://www.example.com/en/1") for i in range(3000)] + [(9999, "https://x.example.com/en/2")], "page_id long, url string")
    rows = judge_urls(pages, rule_frame(spark)).collect()
    assert len(rows) == 3001
    assert {(r["rule"], r["verdict"]) for r in rows} == {("www.example.com/en/", "allow"), ("example.com/en/", "block")}
    assert judge_urls(pages.limit(0), rule_frame(spark)).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, rule_frame(spark).limit(0)).collect()} == {"allow"}
    assert len(RULES) == 5


def test_very_long_hosts_and_paths_make_few_short_keys(spark):
    long = ".".join(["a"] * 30_000) + ".www.example.com"
    rows = [(1, f"http://{long}/en/" + "x" * 100_000), (2, f"http://{long}/de"), (3, "http://" + "b" * 200_000 + ".net/es/"), (4, "http://" + "." * 5000), (5, "http://com" + "/y" * 50_000)]
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rule_frame(spark)).collect()}
    assert out == {1: ("www.example.com/en/", "allow"), 2: ("com/", "allow"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: ("com/", "allow")}
    keys = spark.createDataFrame([(long, "/p" * 999)], "h string, p string").select(url_filter._suffix_keys(F.col("h"), F.col("p"), 3, 24).alias("k")).first()["k"]
    assert len(keys) == 3 and all(len(k) <= 24 for k in keys)
