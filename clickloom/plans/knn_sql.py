"""DuckDB SQL of the kNN plan, for each set of parameters."""

from __future__ import annotations

from ..operators.knn import KnnParams

_DECAY = {
    "canonical": "CASE WHEN step < 100 THEN 1 - 0.1::DOUBLE * step ELSE 0 END",
    "linear": "CASE WHEN step <= 100 THEN 1 - 0.1::DOUBLE * step ELSE 0 END",
    "same": "1.0::DOUBLE",
    "div": "1.0::DOUBLE / step",
    "log": "1.0::DOUBLE / log10(step + 1.7::DOUBLE)",
    "quadratic": "1.0::DOUBLE / (step * step)",
}
_WEIGHT = {
    "place": "pos::DOUBLE",
    "linear": "CASE WHEN pos <= 10 THEN 1 - 0.1::DOUBLE * (len - pos) ELSE 0 END",
    "same": "1.0::DOUBLE",
    "div": "pos::DOUBLE / len",
    "log": "1.0::DOUBLE / log10(len - pos + 1.7::DOUBLE)",
    "quadratic": "pow(pos::DOUBLE / len, 2)",
}
_TIE = {"newer": "time DESC, sid DESC", "larger_id": "sid DESC", "lower_id": "sid"}


def idf_select(mode: str, table: str = "history") -> str:
    pairs = f"(SELECT DISTINCT SessionId, ItemId FROM {table})"
    of = pairs if mode in ("pairs", "sessions") else table
    total = {"pairs": f"SELECT count(*) FROM {pairs}", "interactions": f"SELECT count(*) FROM {table}"}.get(mode, f"SELECT count(DISTINCT SessionId) FROM {table}")
    return f"SELECT ItemId, ln(({total})::DOUBLE / count(*)) AS idf FROM {of} GROUP BY ItemId"


def postings_select(m: int, table: str = "history") -> str:
    return f"""SELECT * FROM (SELECT ItemId, SessionId, Time, row_number() OVER (PARTITION BY ItemId ORDER BY Time DESC, SessionId DESC) AS rank
        FROM (SELECT DISTINCT SessionId, ItemId FROM {table}) JOIN (SELECT SessionId, max(Time) AS Time FROM {table} GROUP BY SessionId) USING (SessionId)) WHERE rank <= {m}"""


def knn_ctes(p: KnnParams, evolving: str = "evolving", history: str = "history") -> str:
    """CTEs weights, cand, near, scores, final over the CTEs of evolving and historical clicks."""
    clipped = f"SELECT eid, item, row_number() OVER (PARTITION BY eid ORDER BY pos) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY pos DESC) AS back FROM {evolving}) WHERE back <= {p.max_clicks or 10**9}"
    step = "greatest(dist - sum(pos) + 1, 1)" if p.duplicates == "multiplicity" else "len - max(pos) + 1"
    weight = "max_by(w, pos)" if p.duplicates == "last" else "sum(w)"
    by = {"distinct": "dist", "length": "len", None: "1"}[p.divide]
    items = "SELECT SessionId, ItemId FROM lists" if p.surviving_items else f"SELECT DISTINCT SessionId, ItemId FROM {history}"
    score = "s * idf" if p.idf_weight is None else f"s + s * idf * {p.idf_weight}"
    recent = f"WHERE r <= {p.m}" if p.m else ""
    seen = f"SELECT DISTINCT eid, item FROM {evolving}" if not p.remind else f"SELECT eid, max_by(item, pos) AS item FROM {evolving} GROUP BY eid"
    shown = "coalesce(score / nullif(max(score) OVER (PARTITION BY eid), 0), 0)" if p.normalise else "score"
    return f"""
        clipped AS ({clipped}),
        lens AS (SELECT eid, count(*) AS len, count(DISTINCT item) AS dist FROM clipped GROUP BY eid),
        weighed AS (SELECT *, {_WEIGHT[p.position]} AS w FROM clipped JOIN lens USING (eid)),
        weights AS (SELECT eid, item, {weight} AS w, ({step})::BIGINT AS step, {by} AS by_ FROM weighed GROUP BY eid, item, len, dist),
        lists AS ({postings_select(p.m or 10**9, history)}),
        pairs AS (SELECT eid, SessionId AS sid, sum(w) / max(by_) AS sim, min(step) AS step, max(Time) AS time FROM weights JOIN lists ON item = ItemId GROUP BY eid, SessionId),
        cand AS (SELECT eid, sid, sim, step, time FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY time DESC, sid DESC) AS r FROM pairs) {recent}),
        near AS (SELECT eid, sid, sim, step, time FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY round(sim, 9) DESC, {_TIE[p.tie]}) AS r FROM cand WHERE sim > 0) WHERE r <= {p.k}),
        sums AS (SELECT eid, ItemId AS item, sum({_DECAY[p.decay]} * sim) AS s FROM near JOIN ({items}) h ON sid = h.SessionId {f'WHERE step <= {p.max_step}' if p.max_step else ''} GROUP BY eid, ItemId),
        idf AS ({idf_select(p.idf, history)}),
        scores AS (SELECT eid, item, {score} AS score FROM sums JOIN idf ON item = ItemId),
        seen AS ({seen}),
        final AS (SELECT eid, item, {shown} AS score FROM scores ANTI JOIN seen USING (eid, item)),
        ranked AS (SELECT eid, row_number() OVER (PARTITION BY eid ORDER BY round(score, 9) DESC, item) AS rank, item, score FROM final),
        top AS (SELECT eid, rank::INT AS rank, item, score FROM ranked WHERE rank <= {p.n})"""
