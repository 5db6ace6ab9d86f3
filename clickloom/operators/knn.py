"""Session-kNN for many evolving sessions at once: neighbours, item scores, top-n. One plan, parameterised by variant."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.weights import DECAYS, POSITION_WEIGHTS
from .index import item_idf, postings
from .skew import split_join


@dataclass(frozen=True)
class KnnParams:
    """m: most recent candidates of an evolving session (None: all). k: neighbours. n: recommendations.
    position: weight of an item by its position (a name of POSITION_WEIGHTS, or `place` for the bare position).
    duplicates: `last` counts an item's last click, `every` sums its clicks' weights, `multiplicity` sums positions and
    reads the step from them. divide: similarities by `distinct` items, the clicks' `length`, or nothing.
    tie: between equally similar sessions: `newer`, `larger_id`, `lower_id`. idf: a mode of item_idf. idf_weight: None multiplies by
    the idf, a number adds score * idf * weight. decay: a name of DECAYS. max_step: of neighbours that score. max_clicks: the last ones used.
    remind: False drops all items of the session, True only the last one. normalise: scores by the session's largest."""

    m: int | None = 500
    k: int = 100
    n: int = 20
    position: str = "place"
    duplicates: str = "last"
    divide: str | None = "distinct"
    tie: str = "newer"
    idf: str = "sessions"
    idf_weight: float | None = None
    decay: str = "canonical"
    max_step: int | None = None
    max_clicks: int | None = None
    remind: bool = True
    normalise: bool = False
    surviving_items: bool = False


CANONICAL = KnnParams()
VARIANTS = {
    "serving": CANONICAL,
    "serving_csv": KnnParams(idf="pairs"),
    "every_click": KnnParams(duplicates="every", divide="length"),
    "sql": KnnParams(m=None, position="div", decay="linear", max_step=100, normalise=True),
    "java": KnnParams(tie="larger_id", idf="rows", decay="linear", max_clicks=99),
    "incremental": KnnParams(duplicates="multiplicity", tie="lower_id", idf="interactions", surviving_items=True),
    "recency": KnnParams(duplicates="every", divide="length", tie="larger_id"),
}
for _name in POSITION_WEIGHTS:
    VARIANTS[f"vsknn_{_name}"] = KnnParams(position=_name, decay=_name, tie="larger_id", idf="rows", idf_weight=1.0)


def numbered(clicks: DataFrame, order: list[str]) -> DataFrame:
    """(eid, item, pos): clicks of evolving sessions with positions from 1, the oldest."""
    pos = F.row_number().over(Window.partitionBy("SessionId").orderBy(*order))
    return clicks.select(F.col("SessionId").alias("eid"), F.col("ItemId").alias("item"), pos.cast("long").alias("pos"))


def evolving_weights(evolving: DataFrame, p: KnnParams) -> DataFrame:
    """(eid, item, w, step, by): an item's weight, its steps from the end, and what similarities are divided by."""
    if p.max_clicks:
        back = Window.partitionBy("eid").orderBy(F.desc("pos"))
        evolving = evolving.withColumn("__back", F.row_number().over(back)).filter(F.col("__back") <= p.max_clicks)
        evolving = evolving.withColumn("pos", F.row_number().over(Window.partitionBy("eid").orderBy("pos")).cast("long")).drop("__back")
    session = Window.partitionBy("eid")
    rows = evolving.withColumn("len", F.count("*").over(session)).withColumn("dist", F.size(F.collect_set("item").over(session)).cast("long"))
    weight = F.col("pos").cast("double") if p.position == "place" else POSITION_WEIGHTS[p.position](F.col("pos"), F.col("len"))
    rows = rows.withColumn("w", weight)
    items = rows.groupBy("eid", "item").agg(F.max("len").alias("len"), F.max("dist").alias("dist"), F.max("pos").alias("pos"), F.sum("w").alias("all"), F.max_by("w", "pos").alias("last"), F.sum("pos").alias("mult"))
    step: Column = F.col("len") - F.col("pos") + 1
    if p.duplicates == "multiplicity":
        step = F.greatest(F.col("dist") - F.col("mult") + 1, F.lit(1))
    w = F.col("last") if p.duplicates == "last" else F.col("all")
    by = {"distinct": F.col("dist"), "length": F.col("len"), None: F.lit(1)}[p.divide]
    return items.select("eid", "item", w.alias("w"), step.cast("long").alias("step"), by.cast("long").alias("by"))


def recent_lists(history: DataFrame, m: int) -> DataFrame:
    """(item, list): each item's m most recent sessions (sid, time) as one row."""
    return packed_lists(postings(history, m))


def packed_lists(rows: DataFrame) -> DataFrame:
    """(item, list) of postings()."""
    return rows.groupBy(F.col("ItemId").alias("item")).agg(F.collect_list(F.struct(F.col("SessionId").alias("sid"), F.col("Time").alias("time"))).alias("list"))


def candidates(evolving: DataFrame, history: DataFrame | None, p: KnnParams = CANONICAL, lists: DataFrame | None = None) -> DataFrame:
    """(eid, sid, time, sim, step): the m most recent sessions that share an item, of equal times the larger id first.

    A session among the m most recent ones of all is among the m most recent ones of each of its items, so that lists of m sessions
    an item are enough, which bounds the join by m rows a click. lists: recent_lists() for m, in place of history.
    """
    weights = evolving_weights(evolving, p)
    # One shuffle by eid serves the sums below and the windows after them; a session's rows are bounded by m for each of its items.
    if p.m:
        # An item's list is one row of at most m sessions; it is unfolded after the shuffle, so that a hot item's rows are spread by eid.
        lists = recent_lists(history, p.m) if lists is None else lists
        shared = split_join(weights, lists, "item", "eid").repartition("eid").select("eid", "w", "step", "by", F.inline("list"))
    else:
        lists = history.select(F.col("SessionId").alias("sid"), F.col("ItemId").alias("item")).distinct().join(history.groupBy(F.col("SessionId").alias("sid")).agg(F.max("Time").alias("time")), "sid")
        shared = split_join(weights, lists, "item", "eid").repartition("eid")
    pairs = shared.groupBy("eid", "sid").agg((F.sum("w") / F.max("by")).alias("sim"), F.min("step").alias("step"), F.max("time").alias("time"))
    if p.m is None:
        return pairs
    recent = Window.partitionBy("eid").orderBy(F.desc("time"), F.desc("sid"))
    return pairs.withColumn("__r", F.row_number().over(recent)).filter(F.col("__r") <= p.m).drop("__r")


def neighbours(evolving: DataFrame, history: DataFrame, p: KnnParams = CANONICAL) -> DataFrame:
    """The k most similar candidates; similarities that differ by rounding only count as equal."""
    ties = {"newer": [F.desc("time"), F.desc("sid")], "larger_id": [F.desc("sid")], "lower_id": [F.asc("sid")]}[p.tie]
    best = Window.partitionBy("eid").orderBy(F.round("sim", 9).desc(), *ties)
    return candidates(evolving, history, p).filter("sim > 0").withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= p.k).drop("__r")


def item_scores(near: DataFrame, history: DataFrame, p: KnnParams = CANONICAL) -> DataFrame:
    """(eid, item, score): decay(step) * similarity summed over neighbours with the item, weighted by idf."""
    if p.max_step:
        near = near.filter(F.col("step") <= p.max_step)
    items = postings(history, p.m) if p.surviving_items and p.m else history
    items = items.select(F.col("SessionId").alias("sid"), F.col("ItemId").alias("item")).distinct()
    part = DECAYS[p.decay](F.col("step")) * F.col("sim")
    idf = item_idf(history, p.idf).select(F.col("ItemId").alias("item"), "idf")
    # The idf joins the history, not the sums, and the rows are shuffled by eid once for the sums and the ranks.
    rows = near.join(items.join(idf, "item"), "sid").repartition("eid")
    sums = rows.groupBy("eid", "item").agg(F.sum(part).alias("s"), F.max("idf").alias("idf"))
    score = F.col("s") * F.col("idf") if p.idf_weight is None else F.col("s") + F.col("s") * F.col("idf") * F.lit(p.idf_weight)
    return sums.select("eid", "item", score.alias("score"))


def without_seen(scores: DataFrame, evolving: DataFrame, remind: bool) -> DataFrame:
    """Scores without the evolving session's last item, or (remind=False) without any of its items."""
    if not remind:
        return scores.join(evolving.select("eid", "item").distinct(), ["eid", "item"], "left_anti")
    last = evolving.groupBy("eid").agg(F.max_by("item", "pos").alias("__last"))
    return scores.join(last, "eid").filter("item != __last").drop("__last")


def top_items(scores: DataFrame, n: int) -> DataFrame:
    """(eid, rank, item, score): the n best items, of equal ones the smaller id first."""
    best = Window.partitionBy("eid").orderBy(F.round("score", 9).desc(), F.asc("item"))
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("eid", "rank", "item", "score")


def recommend(evolving: DataFrame, history: DataFrame, p: KnnParams = CANONICAL) -> DataFrame:
    """(eid, rank, item, score) for evolving(eid, item, pos) against history(SessionId, ItemId, Time)."""
    scores = without_seen(item_scores(neighbours(evolving, history, p), history, p), evolving, p.remind)
    if p.normalise:
        scores = scores.withColumn("score", F.coalesce(F.col("score") / F.nullif(F.max("score").over(Window.partitionBy("eid")), F.lit(0.0)), F.lit(0.0)))
    return top_items(scores, p.n)


def recommendation_lists(recommended: DataFrame) -> DataFrame:
    """(eid, recs): items by rank."""
    return recommended.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("recs"))


def variant(name: str, **changes: object) -> KnnParams:
    return replace(VARIANTS[name], **changes)
