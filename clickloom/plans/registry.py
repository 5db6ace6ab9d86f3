"""All queries over the driver's tables, and the SQL to check them.

Scores are rounded to six digits, since sums of doubles depend on their order. m and k are small enough to bind on these tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, weights
from ..operators import clean, index, knn, similar
from ..operators.knn import VARIANTS, KnnParams
from ..session import shared_dir, stored
from ..sources import readers, sinks
from ..streaming import incremental, state
from . import models, replay, tables, tuning
from .knn_sql import idf_select, knn_ctes, postings_select
from .tables import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Bounds that bind on the test tables.
BOUND = {"m": 50, "k": 20}
_CLEAN_GAP = 43200


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def six(c: str | Column) -> Column:
    return F.round(c, 6)


def _bound(name: str) -> KnnParams:
    p = VARIANTS[name]
    return replace(p, k=BOUND["k"], m=BOUND["m"] if p.m else None)


# Recommendations, one query for each variant.


def _add_variant(name: str, p: KnnParams) -> None:
    sql = with_tables("clicks history evolving", knn_ctes(p) + " SELECT eid, rank, item, round(score, 6) AS score FROM top")

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return knn.recommend(tables.evolving(spark, sf), tables.history(spark, sf), p).withColumn("score", six("score"))


_add_variant("recommend_topn", knn.CANONICAL)
for _name in VARIANTS:
    _add_variant(f"recommend_{_name}", _bound(_name))
_add_variant("reminder_filter", replace(_bound("serving"), remind=False))


@query("candidates_topm", with_tables("clicks history evolving", knn_ctes(_bound("serving")) + " SELECT eid, sid, time, step, round(sim, 6) AS sim FROM cand"))
def candidates_topm(spark: SparkSession, sf: str) -> DataFrame:
    return knn.candidates(tables.evolving(spark, sf), tables.history(spark, sf), _bound("serving")).select("eid", "sid", "time", "step", six("sim").alias("sim"))


@query("neighbors_topk", with_tables("clicks history evolving", knn_ctes(_bound("serving")) + " SELECT eid, sid, time, step, round(sim, 6) AS sim FROM near"))
def neighbors_topk(spark: SparkSession, sf: str) -> DataFrame:
    return models.SessionKnn(_bound("serving")).fit(tables.history(spark, sf)).find_neighbours(tables.evolving(spark, sf)).select("eid", "sid", "time", "step", six("sim").alias("sim"))


@query(
    "business_rules",
    with_tables(
        "clicks history evolving flags",
        knn_ctes(_bound("serving"))
        + """, cur AS (SELECT e.eid, f.IsAdult FROM (SELECT eid, max_by(item, pos) AS item FROM evolving GROUP BY eid) e JOIN flags f ON e.item = f.ItemId),
        ok AS (SELECT s.eid, s.item, s.score FROM final s JOIN flags f ON s.item = f.ItemId LEFT JOIN cur c ON c.eid = s.eid WHERE f.ForSale AND (NOT f.IsAdult OR coalesce(c.IsAdult, false)))
        SELECT eid, rank, item, round(score, 6) AS score FROM (SELECT *, (row_number() OVER (PARTITION BY eid ORDER BY round(score, 9) DESC, item))::INT AS rank FROM ok) WHERE rank <= 20""",
    ),
)
def business_rules(spark: SparkSession, sf: str) -> DataFrame:
    history = tables.history(spark, sf)
    flags = index.catalog_flags(tables.catalog(spark, sf), history)
    return models.SessionKnn(_bound("serving")).fit(history, flags).predict(tables.evolving(spark, sf), business_rules=True).withColumn("score", six("score"))


# Index building.


@query("clicks_dedup", with_tables("clicks", "SELECT SessionId, ItemId, max(Time) AS Time FROM clicks GROUP BY ALL"))
def clicks_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return clean.latest_clicks(tables.clicks(spark, sf))


@query("session_index", with_tables("clicks", "SELECT SessionId, string_agg(DISTINCT ItemId::VARCHAR, ',' ORDER BY ItemId::VARCHAR) AS items, max(Time) AS Time FROM clicks GROUP BY SessionId"))
def session_index(spark: SparkSession, sf: str) -> DataFrame:
    out = index.session_index(tables.clicks(spark, sf))
    return out.select("SessionId", F.array_join(F.array_sort(F.col("item_ids_asc").cast("array<string>")), ",").alias("items"), "Time")


def _add_idf(mode: str) -> None:
    @query(f"item_idf_{mode}", with_tables("clicks", f"SELECT ItemId, round(idf, 6) AS idf FROM ({idf_select(mode, 'clicks')})"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return index.item_idf(tables.clicks(spark, sf), mode).withColumn("idf", six("idf"))


for _mode in ("pairs", "sessions", "rows", "interactions"):
    _add_idf(_mode)


@query("item_posting_topm", with_tables("clicks", f"SELECT ItemId, SessionId, Time, rank::INT AS rank FROM ({postings_select(10, 'clicks')})"))
def item_posting_topm(spark: SparkSession, sf: str) -> DataFrame:
    return index.postings(tables.clicks(spark, sf), 10)


@query(
    "item_index",
    with_tables("clicks", f"SELECT ItemId, string_agg(SessionId::VARCHAR, ',' ORDER BY rank) AS sessions, round(max(idf), 6) AS idf FROM ({postings_select(10, 'clicks')}) JOIN ({idf_select('sessions', 'clicks')}) USING (ItemId) GROUP BY ItemId"),
)
def item_index(spark: SparkSession, sf: str) -> DataFrame:
    out = index.item_index(tables.clicks(spark, sf), 10)
    return out.select("ItemId", F.array_join(F.col("session_indices_time_ordered").cast("array<string>"), ",").alias("sessions"), six("idf").alias("idf"))


@query(
    "training_stats",
    with_tables(
        "clicks",
        "s AS (SELECT count(*) AS n, max(Time) - min(Time) AS duration FROM clicks GROUP BY SessionId) SELECT (SELECT count(*) FROM clicks) AS records, (SELECT count(DISTINCT SessionId) FROM clicks) AS sessions, (SELECT count(DISTINCT ItemId) FROM clicks) AS items, (SELECT min(Time) FROM clicks) AS first, (SELECT max(Time) FROM clicks) AS last, "
        + ", ".join(f"round(quantile_cont({c}, {q}))::BIGINT AS {c}_{k}" for c in ("n", "duration") for k, q in {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_5": 0.995, "p100": 1.0}.items())
        + " FROM s",
    ),
)
def training_stats(spark: SparkSession, sf: str) -> DataFrame:
    return index.training_stats(tables.clicks(spark, sf))


@query("dense_session_ids", with_tables("clicks", "SELECT SessionId, row_number() OVER (ORDER BY SessionId) - 1 AS SessionIndex FROM (SELECT DISTINCT SessionId FROM clicks)"))
def dense_session_ids(spark: SparkSession, sf: str) -> DataFrame:
    return clean.dense_ids(tables.clicks(spark, sf), "SessionId", "SessionIndex")


@query("catalog_flags", with_tables("clicks all_flags", "SELECT h.ItemId, coalesce(IsAdult, false) AS IsAdult, coalesce(ForSale, false) AS ForSale FROM (SELECT DISTINCT ItemId FROM clicks) h LEFT JOIN all_flags f USING (ItemId)"))
def catalog_flags(spark: SparkSession, sf: str) -> DataFrame:
    items = tables.clicks(spark, sf).select("ItemId").distinct()
    return index.flagged_index(items, index.catalog_flags(tables.catalog(spark, sf), items))


@query(
    "seed_subgraph",
    with_tables(
        "clicks",
        f"""posts AS ({postings_select(10, 'clicks')}), sess AS (SELECT DISTINCT SessionId FROM posts WHERE ItemId = 100)
        SELECT ItemId, string_agg(SessionId::VARCHAR, ',' ORDER BY rank) AS sessions, round(max(idf), 6) AS idf FROM posts SEMI JOIN sess USING (SessionId) JOIN ({idf_select("sessions", "clicks")}) USING (ItemId) GROUP BY ItemId""",
    ),
)
def seed_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    items, _ = index.seed_subgraph(index.item_index(tables.clicks(spark, sf), 10), 100)
    return items.select("ItemId", F.array_join(F.col("session_indices_time_ordered").cast("array<string>"), ",").alias("sessions"), six("idf").alias("idf"))


# Cleaning.


@query("relevant_events", with_tables("raw event_clicks", "SELECT * FROM event_clicks"))
def relevant_events(spark: SparkSession, sf: str) -> DataFrame:
    return clean.as_clicks(clean.relevant_events(tables.raw_events(spark, sf)))


_BUYERS = "buyers AS (SELECT * FROM event_clicks WHERE qty_detailpage + qty_add_to_cart > 0 AND bui IN (SELECT bui FROM event_clicks WHERE qty_purchased > 0))"


@query("buyers_semi_join", with_tables("raw event_clicks", f"{_BUYERS} SELECT * FROM buyers"))
def buyers_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return clean.buyers_clicks(relevant_events(spark, sf))


def _sessions_sql(gap: int) -> str:
    return f"""{_BUYERS}, lagged AS (SELECT *, CASE WHEN Time - lag(Time) OVER (PARTITION BY bui ORDER BY Time) < {gap} THEN 0 ELSE 1 END AS opens FROM buyers),
        sessions AS (SELECT bui::VARCHAR || '_' || (sum(opens) OVER (PARTITION BY bui ORDER BY Time RANGE UNBOUNDED PRECEDING))::BIGINT AS SessionId, ItemId, Time FROM lagged)"""


@query("sessionize_events", with_tables("raw event_clicks", _sessions_sql(1200) + " SELECT * FROM sessions"))
def sessionize_events(spark: SparkSession, sf: str, gap: int = 1200) -> DataFrame:
    return clean.sessionize(buyers_semi_join(spark, sf), gap).select("SessionId", "ItemId", "Time")


_LATEST = _sessions_sql(_CLEAN_GAP) + ", latest AS (SELECT SessionId, ItemId, max(Time) AS Time FROM sessions GROUP BY ALL)"


@query("most_recent_session_item", with_tables("raw event_clicks", f"{_LATEST} SELECT * FROM latest"))
def most_recent_session_item(spark: SparkSession, sf: str) -> DataFrame:
    return clean.latest_clicks(sessionize_events(spark, sf, _CLEAN_GAP))


@query("min_support", with_tables("clicks", "SELECT SessionId, ItemId, Time FROM clicks QUALIFY count(*) OVER (PARTITION BY ItemId) >= 30"))
def min_support(spark: SparkSession, sf: str) -> DataFrame:
    return clean.min_support(tables.clicks(spark, sf), "ItemId", 30).select("SessionId", "ItemId", "Time")


_CASCADE = """c1 AS (SELECT * FROM latest QUALIFY count(*) OVER (PARTITION BY SessionId) >= 2), c2 AS (SELECT * FROM c1 QUALIFY count(*) OVER (PARTITION BY ItemId) >= 5),
    c3 AS (SELECT * FROM c2 QUALIFY count(*) OVER (PARTITION BY SessionId) >= 2)"""


@query("min_support_cascade", with_tables("raw event_clicks", f"{_LATEST}, {_CASCADE} SELECT * FROM c3"))
def min_support_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return clean.support_cascade(most_recent_session_item(spark, sf))


@query(
    "full_index_job",
    with_tables(
        "raw event_clicks",
        f"""{_LATEST}, {_CASCADE}, lens AS (SELECT SessionId, count(*) AS n FROM c3 GROUP BY SessionId), kept AS (SELECT * FROM c3 WHERE SessionId IN (SELECT SessionId FROM lens WHERE n <= (SELECT quantile_cont(n, 0.995) FROM lens)))
        SELECT ItemId AS id, least(count(*), 500)::INT AS n, 'item' AS kind FROM kept GROUP BY ItemId
        UNION ALL SELECT row_number() OVER (ORDER BY SessionId) - 1 AS id, count(*)::INT AS n, 'session' AS kind FROM kept GROUP BY SessionId""",
    ),
)
def full_index_job(spark: SparkSession, sf: str) -> DataFrame:
    """The index job end to end over raw events, written and read back: each list by its length."""
    base = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    items, sessions = models.build_indexes(tables.raw_events(spark, sf), tables.catalog(spark, sf), gap=_CLEAN_GAP)
    sinks.write_index(items, sessions, base, files=2)
    items, sessions = readers.read_index(spark, base)
    return items.select(F.col("ItemId").alias("id"), F.size("session_indices_time_ordered").alias("n"), F.lit("item").alias("kind")).union(sessions.select(F.col("SessionIndex").alias("id"), F.size("item_ids_asc").alias("n"), F.lit("session").alias("kind")))


_LENGTHS = "lens AS (SELECT SessionId, count(*) AS n FROM clicks GROUP BY SessionId)"


@query("session_len_percentile", with_tables("clicks", f"{_LENGTHS} SELECT quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.995) AS p99_5 FROM lens"))
def session_len_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return clean.session_stats(tables.clicks(spark, sf)).agg(F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.995)).alias("p99_5"))


def _add_outliers(name: str, strict: bool, rounded: bool) -> None:
    limit = "round(quantile_cont(n, 0.9))" if rounded else "quantile_cont(n, 0.9)"

    @query(name, with_tables("clicks", f"{_LENGTHS} SELECT SessionId, ItemId, Time FROM clicks WHERE SessionId IN (SELECT SessionId FROM lens WHERE n {'<' if strict else '<='} (SELECT {limit} FROM lens))"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return clean.without_long_sessions(tables.clicks(spark, sf), 0.9, strict, rounded).select("SessionId", "ItemId", "Time")


_add_outliers("outlier_filter", False, False)
_add_outliers("outlier_filter_strict", True, False)
_add_outliers("outlier_filter_rounded", False, True)


@query("last_n_days", with_tables("clicks", "SELECT SessionId, ItemId, Time FROM clicks WHERE Time >= (SELECT max(Time) // 86400 * 86400 - 100 * 86400 FROM clicks)"))
def last_n_days(spark: SparkSession, sf: str) -> DataFrame:
    return clean.last_days(tables.clicks(spark, sf), 100).select("SessionId", "ItemId", "Time")


@query(
    "sanitize_training",
    with_tables(
        "clicks",
        """pairs AS (SELECT DISTINCT SessionId, ItemId FROM clicks), s AS (SELECT SessionId, max(Time) AS Time FROM clicks GROUP BY SessionId HAVING count(DISTINCT ItemId) <= 6)
        SELECT SessionId, ItemId, Time FROM pairs JOIN s USING (SessionId) QUALIFY row_number() OVER (PARTITION BY ItemId ORDER BY Time DESC, SessionId DESC) <= 10""",
    ),
)
def sanitize_training(spark: SparkSession, sf: str) -> DataFrame:
    return clean.sanitize_training(tables.clicks(spark, sf), 10, 6)


@query("first_clicks", with_tables("clicks", "SELECT SessionId, ItemId, Time, pos FROM clicks ORDER BY Time, SessionId, pos LIMIT 1000"))
def first_clicks(spark: SparkSession, sf: str) -> DataFrame:
    """The limit is the feature: a test run over the first rows of a log."""
    return clean.first_rows(tables.clicks(spark, sf), 1000, ["Time", "SessionId", "pos"])


@query("truncate_sessions", with_tables("clicks", "SELECT SessionId, ItemId, Time FROM clicks QUALIFY row_number() OVER (PARTITION BY SessionId ORDER BY pos DESC, ItemId DESC) <= 2"))
def truncate_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return clean.last_items(tables.clicks(spark, sf), 2).select("SessionId", "ItemId", "Time")


@query(
    "dwell_weights",
    with_tables(
        "clicks",
        """g AS (SELECT SessionId, ItemId, pos, lead(Time) OVER (PARTITION BY SessionId ORDER BY Time, pos, ItemId) - Time AS gap FROM clicks)
        SELECT SessionId, ItemId, pos, CASE WHEN gap IS NULL OR max(gap) OVER (PARTITION BY SessionId) = 0 THEN 1 ELSE gap::DOUBLE / max(gap) OVER (PARTITION BY SessionId) END AS weight FROM g""",
    ),
)
def dwell_weights(spark: SparkSession, sf: str) -> DataFrame:
    """One division of two whole numbers, so that the doubles are equal without rounding."""
    return clean.dwell_weights(tables.clicks(spark, sf)).select("SessionId", "ItemId", "pos", "weight")


@query("hash_partition", with_tables("clicks", "SELECT count(*) AS n, count(DISTINCT SessionId) AS sessions, true AS whole FROM clicks"))
def hash_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions dealt to 4 parts: their counts add up, and no session lies in two parts."""
    parts = tables.clicks(spark, sf).withColumn("part", readers.partition_of(F.col("SessionId"), 4)).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("SessionId").alias("s"))
    return parts.agg(F.sum("n").alias("n"), F.sum("s").alias("sessions"), (F.count("*") <= 4).alias("whole"))


@query("evolving_sessions", with_tables("clicks", "SELECT SessionId, string_agg(ItemId::VARCHAR, ',' ORDER BY Time, ItemId) AS items FROM clicks GROUP BY SessionId"))
def evolving_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return readers.evolving_sessions(tables.clicks(spark, sf)).select("SessionId", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


# Similarities and decays.

_SETS_SQL = """sizes AS (SELECT SessionId, count(DISTINCT ItemId)::DOUBLE AS n FROM clicks GROUP BY SessionId), d AS (SELECT DISTINCT SessionId, ItemId FROM clicks),
    common AS (SELECT e.SessionId AS eid, h.SessionId AS sid, count(*)::DOUBLE AS c FROM d e JOIN d h USING (ItemId) WHERE e.SessionId <> h.SessionId GROUP BY ALL),
    p AS (SELECT eid, sid, c, a.n AS l, b.n AS r FROM common JOIN sizes a ON a.SessionId = eid JOIN sizes b ON b.SessionId = sid)"""
_SIM_SQL = {"jaccard": "c / (l + r - c)", "tanimoto": "c / (l + r - c)", "cosine": "c / (sqrt(l) * sqrt(r))", "cosine_legacy": "c / sqrt(l) * sqrt(r)", "binary": "2 * c / (2 * c + l + r)"}


def _add_similarity(kind: str) -> None:
    @query(f"sim_{kind}", with_tables("clicks", f"{_SETS_SQL} SELECT eid, count(*) AS n, round(sum(s), 4) AS total, round(max(s), 6) AS most FROM (SELECT eid, {_SIM_SQL[kind]} AS s FROM p) GROUP BY eid"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = similar.similar_sessions(tables.clicks(spark, sf), kind)
        return found.select("eid", "n", F.round("total", 4).alias("total"), six("most").alias("most"))


for _kind in _SIM_SQL:
    _add_similarity(_kind)


@query(
    "time_decay",
    with_tables("clicks history evolving", "enow AS (SELECT SessionId AS eid, max(Time) AS now FROM clicks GROUP BY SessionId), " + knn_ctes(_bound("serving")) + " SELECT eid, sid, round(sim * pow(0.875::DOUBLE, round_even(abs(now - time)::DOUBLE / 86400, 0)), 6) AS sim FROM near JOIN enow USING (eid)"),
)
def time_decay(spark: SparkSession, sf: str) -> DataFrame:
    now = tables.clicks(spark, sf).groupBy(F.col("SessionId").alias("eid")).agg(F.max("Time").alias("now"))
    near = knn.neighbours(tables.evolving(spark, sf), tables.history(spark, sf), _bound("serving")).join(now, "eid")
    return near.select("eid", "sid", six(weights.time_decay(F.col("sim"), F.abs(F.col("now") - F.col("time")))).alias("sim"))


# Replay, metrics and tuning.

_PREFIX_SQL = """lists_e AS (SELECT eid, list(item ORDER BY pos) AS items FROM evolving GROUP BY eid HAVING count(*) > 1),
    prefix AS (SELECT eid, p AS position, items[1:p] AS history, items[p+1:] AS next_items FROM lists_e, unnest(range(1, len(items))) AS t(p))"""


@query("replay_prefixes", with_tables("clicks evolving", f"{_PREFIX_SQL} SELECT eid AS SessionId, position::INT AS position, array_to_string(history, ',') AS history, array_to_string(next_items, ',') AS next_items FROM prefix"))
def replay_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    rows = replay.prefixes(tables.evolving(spark, sf))
    return rows.select("SessionId", "position", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("history", "next_items")])


_REPLAY_P = replace(knn.CANONICAL, **BOUND)
_PRED_SQL = (
    f"{_PREFIX_SQL}, evo2 AS (SELECT eid::VARCHAR || ':' || position AS eid, u.item AS item, u.n AS pos FROM prefix, LATERAL (SELECT unnest(history) AS item, generate_subscripts(history, 1) AS n) u), "
    + knn_ctes(_REPLAY_P, "evo2")
    + """, recs AS (SELECT eid, list(item ORDER BY rank) AS recs FROM top GROUP BY eid),
    pred AS (SELECT p.eid AS SessionId, position, coalesce(recs, []) AS recs, next_items FROM prefix p LEFT JOIN recs r ON r.eid = p.eid::VARCHAR || ':' || position),
    m AS (SELECT *, list_position(recs[1:20], next_items[1]) AS r, list_distinct(list_intersect(recs[1:20], next_items)) AS shared FROM pred),
    gains AS (SELECT *, coalesce(1.0::DOUBLE / nullif(r, 0), 0) AS mrr, (coalesce(r, 0) > 0)::INT::DOUBLE AS hitrate, len(shared) / 20.0::DOUBLE AS precision, len(shared)::DOUBLE / len(next_items) AS recall,
        list_sum(list_transform(recs[1:20], lambda x, i: CASE WHEN list_contains(next_items, x) THEN CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / log2(i) END ELSE 0 END)) AS dcg,
        list_sum(list_transform(next_items[1:20], lambda x, i: CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / log2(i) END)) AS idcg,
        list_transform(range(0, 20), lambda k: len(list_distinct(list_intersect(recs[1:k], next_items)))::DOUBLE) AS found FROM m),
    rows_ AS (SELECT *, coalesce(dcg / idcg, 0) AS ndcg, list_sum(list_transform(range(1, 21), lambda k: found[k] / 20 * (found[k] - CASE WHEN k > 1 THEN found[k - 1] ELSE 0 END) / len(next_items))) AS map FROM gains)"""
)


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return stored(replay.predictions(tables.evolving(spark, sf), tables.history(spark, sf), _REPLAY_P), "predictions")


@query("replay_predictions", with_tables("clicks history evolving", f"{_PRED_SQL} SELECT SessionId, position::INT AS position, array_to_string(recs, ',') || ';' || array_to_string(next_items, ',') AS line FROM pred"))
def replay_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).select("SessionId", "position", sinks.prediction_line(F.col("recs"), F.col("next_items")).alias("line"))


def _add_metric(name: str) -> None:
    @query(f"metric_{name}", with_tables("clicks history evolving", f"{_PRED_SQL} SELECT SessionId, position::INT AS position, round({name}, 6) AS value FROM rows_"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _predictions(spark, sf).select("SessionId", "position", six(metrics.ROW_METRICS[name](F.col("recs"), F.col("next_items"), 20)).alias("value"))


for _metric in metrics.ROW_METRICS:
    _add_metric(_metric)


@query("metric_f1", with_tables("clicks history evolving", f"{_PRED_SQL} SELECT round(2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall)), 6) AS f1 FROM rows_"))
def metric_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.means(_predictions(spark, sf), 20).select(six("f1").alias("f1"))


_COVERAGE = "(SELECT count(DISTINCT i)::DOUBLE FROM (SELECT unnest(recs) AS i FROM pred)) / (SELECT count(DISTINCT ItemId) FROM history)"
_POPULARITY = """(SELECT avg(p) FROM (SELECT any_value(d) AS d, sum(coalesce(f.pop, 0)) / greatest(any_value(d), 1) AS p FROM
    (SELECT row_number() OVER () AS id, list_distinct(recs) AS l, len(list_distinct(recs)) AS d FROM pred) x LEFT JOIN LATERAL (SELECT unnest(x.l) AS i) u ON true
    LEFT JOIN (SELECT ItemId, count(*)::DOUBLE / max(count(*)) OVER () AS pop FROM history GROUP BY ItemId) f ON f.ItemId = u.i GROUP BY x.id))"""


@query("metric_coverage", with_tables("clicks history evolving", f"{_PRED_SQL} SELECT round({_COVERAGE}, 6) AS coverage"))
def metric_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.coverage(_predictions(spark, sf), tables.history(spark, sf), 20).select(six("coverage").alias("coverage"))


@query("metric_popularity", with_tables("clicks history evolving", f"{_PRED_SQL} SELECT round({_POPULARITY}, 6) AS popularity"))
def metric_popularity(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.popularity(_predictions(spark, sf), tables.history(spark, sf), 20).select(six("popularity").alias("popularity"))


@query(
    "metrics_report",
    with_tables(
        "clicks history evolving",
        f"{_PRED_SQL} SELECT round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(hitrate), 4) AS hitrate, round({_POPULARITY}, 4) AS popularity, round(avg(precision), 4) AS precision, round({_COVERAGE}, 4) AS coverage, round(avg(recall), 4) AS recall, round(2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall)), 4) AS f1, round(avg(map), 4) AS map FROM rows_",
    ),
)
def metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.report(_predictions(spark, sf), tables.history(spark, sf))


@query("mrr_by_position", with_tables("clicks history evolving", f"{_PRED_SQL} SELECT position::INT AS position, round(avg(mrr), 6) AS mrr, round(avg(hitrate), 6) AS hitrate, count(*) AS n FROM rows_ GROUP BY position"))
def mrr_by_position(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_position(_predictions(spark, sf), 20).select("position", six("mrr").alias("mrr"), six("hitrate").alias("hitrate"), "n")


@query(
    "mrr_by_popularity",
    with_tables(
        "clicks history evolving",
        f"{_PRED_SQL}, pop AS (SELECT ItemId, count(*)::DOUBLE / max(count(*)) OVER () AS popularity FROM history GROUP BY ItemId) SELECT least(9, floor(coalesce(popularity, 0) * 10))::INT AS pop_bin, round(avg(mrr), 6) AS mrr, round(avg(hitrate), 6) AS hitrate, count(*) AS n FROM rows_ LEFT JOIN pop ON ItemId = next_items[1] GROUP BY 1",
    ),
)
def mrr_by_popularity(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_popularity(_predictions(spark, sf), tables.history(spark, sf), 20).select("pop_bin", six("mrr").alias("mrr"), six("hitrate").alias("hitrate"), "n")


@query("item_popularity", with_tables("clicks", "SELECT ItemId, round(count(*)::DOUBLE / max(count(*)) OVER (), 6) AS popularity FROM clicks GROUP BY ItemId"))
def item_popularity(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.popularity_table(tables.clicks(spark, sf)).withColumn("popularity", six("popularity"))


@query("predictions_roundtrip", with_tables("clicks history evolving", f"{_PRED_SQL} SELECT array_to_string(recs, ',') AS recs, array_to_string(next_items, ',') AS next_items FROM pred"))
def predictions_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/predictions-{uuid.uuid4().hex}"
    sinks.write_predictions(_predictions(spark, sf), path)
    return readers.read_predictions(spark, path).select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("recs", "next_items")])


@query("json_responses", with_tables("clicks history evolving", knn_ctes(_bound("serving")) + " SELECT eid, '[' || string_agg(item::VARCHAR, ',' ORDER BY rank) || ']' AS body FROM top GROUP BY eid"))
def json_responses(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.json_responses(knn.recommend(tables.evolving(spark, sf), tables.history(spark, sf), _bound("serving")))


@query("param_grid", "SELECT m::BIGINT AS m, k::BIGINT AS k, x::BIGINT AS max_items FROM (SELECT unnest([100, 250, 500, 750, 1000, 2500]) AS m), (SELECT unnest([50, 100, 500, 1000, 1500]) AS k), (SELECT unnest([1, 2, 3, 5, 7, 15, 100]) AS x) WHERE k <= m")
def param_grid(spark: SparkSession, sf: str) -> DataFrame:
    return tuning.grid(spark, tuning.SEARCH_GRID).filter("k <= m")


@query("random_params")
def random_params(spark: SparkSession, sf: str) -> DataFrame:
    return tuning.random_combinations(spark, tuning.SEARCH_GRID, 150)


_TRIED = {"m": [20, 50], "k": [10, 50], "max_items": [2]}


def _search_sql() -> str:
    parts = []
    for m in _TRIED["m"]:
        for k in _TRIED["k"]:
            if k <= m:
                p = replace(knn.CANONICAL, m=m, k=k)
                cut = _PREFIX_SQL.replace("items[1:p] AS history", "items[greatest(1, p - 1):p] AS history")
                body = with_tables("clicks history evolving", _PRED_SQL.replace(_PREFIX_SQL, cut).replace(knn_ctes(_REPLAY_P, "evo2"), knn_ctes(p, "evo2")) + f" SELECT {m}::BIGINT AS m, {k}::BIGINT AS k, 2::BIGINT AS max_items, avg(mrr) AS mrr FROM rows_")
                parts.append(f"SELECT * FROM ({body})")
    return "SELECT m, k, max_items, round(mrr, 6) AS mrr FROM (" + " UNION ALL ".join(parts) + ") ORDER BY round(mrr, 9) DESC, m, k, max_items LIMIT 1"


@query("hyperparam_best", _search_sql())
def hyperparam_best(spark: SparkSession, sf: str) -> DataFrame:
    found = tuning.search(tables.evolving(spark, sf), tables.history(spark, sf), tuning.grid(spark, _TRIED))
    return tuning.best(found).withColumn("mrr", six("mrr"))


@query("hyperparam_search")
def hyperparam_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best combination of the published grid; hyperparam_best is the same search over three combinations, small enough for SQL."""
    found = tuning.search(tables.evolving(spark, sf), tables.history(spark, sf), tuning.grid(spark, tuning.SEARCH_GRID))
    return tuning.best(found).withColumn("mrr", six("mrr"))


# Streaming.


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return rows.select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("session_id"), F.get_json_object("props", "$.k").cast("long").alias("item_id"), tables.seconds("ts").alias("time"), (F.col("user_id") % 7 != 0).alias("user_consent"))


def _text_items(df: DataFrame) -> DataFrame:
    return df.select("session_key", "request_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


#: A session's items at a click are the last ones since it was idle, without clicks that repeat the one before.
_STATE_SQL = f"""WITH r AS (SELECT event_id AS request_id, md5(user_id::VARCHAR) AS session_key, (props->>'$.k')::BIGINT AS item_id, floor(epoch(ts))::BIGINT AS time, user_id % 7 <> 0 AS user_consent FROM events),
    lagged AS (SELECT *, coalesce(time - lag(time) OVER w > {_CLEAN_GAP}, true) AS opens, lag(item_id) OVER w IS DISTINCT FROM item_id AS other FROM r WHERE user_consent WINDOW w AS (PARTITION BY session_key ORDER BY time, request_id)),
    parts AS (SELECT *, sum(opens::INT) OVER (PARTITION BY session_key ORDER BY time, request_id ROWS UNBOUNDED PRECEDING) AS part FROM lagged),
    lists AS (SELECT session_key, request_id, list(item_id) FILTER (WHERE opens OR other) OVER (PARTITION BY session_key, part ORDER BY time, request_id ROWS UNBOUNDED PRECEDING) AS items FROM parts)
    SELECT session_key, request_id, array_to_string(items[-4:], ',') AS items FROM lists
    UNION ALL SELECT session_key, request_id, item_id::VARCHAR AS items FROM r WHERE NOT user_consent"""


@query("session_state_batch", _STATE_SQL)
def session_state_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _text_items(state.evolve_batch(_requests(spark, sf), idle=_CLEAN_GAP, most=4))


@query("session_state_stream", _STATE_SQL)
def session_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The requests as a file stream through the stateful operator; the result is what the stream wrote."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    requests = _requests(spark, sf)
    incremental.replay_source(requests, f"{base}/in", 2)
    stream = spark.readStream.schema(requests.schema).parquet(f"{base}/in")
    out = state.evolve(stream, idle=_CLEAN_GAP, most=4)
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return _text_items(spark.read.schema(state.OUTPUT).parquet(f"{base}/out"))


@query("incremental_stream", ORACLE_SQL["recommend_serving"])
def incremental_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Evolving clicks arrive in files, sessions spread over them; the view at the end equals the batch result."""
    base = f"{shared_dir(spark)}/clicks-{uuid.uuid4().hex}"
    clicks = stored(tables.evolving(spark, sf), "evolving")
    clicks.repartitionByRange(2, "pos").write.parquet(base)
    view = incremental.IncrementalScores(stored(tables.history(spark, sf), "history"), _bound("serving"))
    view.start(spark.readStream.schema(clicks.schema).option("maxFilesPerTrigger", 1).parquet(base)).awaitTermination()
    return view.current().withColumn("score", six("score"))


@query("session_runs", with_tables("clicks", "p AS (SELECT *, row_number() OVER (ORDER BY Time, SessionId, pos) AS place FROM clicks), g AS (SELECT *, place - row_number() OVER (PARTITION BY SessionId ORDER BY place) AS grp FROM p) SELECT SessionId, min(place)::BIGINT AS run, string_agg(ItemId::VARCHAR, ',' ORDER BY place) AS items FROM g GROUP BY SessionId, grp"))
def session_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.clicks(spark, sf).withColumn("key", F.struct("Time", "SessionId", "pos"))
    return readers.runs_of_sessions(rows, "key").select("SessionId", "run", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("rules_on_flags", with_tables("clicks all_flags", "SELECT ForSale AS for_sale, IsAdult AS adult, count(*) AS n FROM all_flags GROUP BY ALL"))
def rules_on_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = index.catalog_flags(tables.catalog(spark, sf), tables.clicks(spark, sf))
    return flags.groupBy(F.col("ForSale").alias("for_sale"), F.col("IsAdult").alias("adult")).agg(F.count("*").alias("n"))

