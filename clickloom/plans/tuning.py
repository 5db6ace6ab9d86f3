"""Parameter grids and hyper-parameter search."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metrics
from ..functions.weights import DECAYS
from ..operators import knn
from ..operators.clean import top_sessions_per_item
from ..operators.knn import KnnParams
from ..operators.skew import split_join
from ..session import stored
from . import replay

#: A fixed value: the grid of the published search.
SEARCH_GRID = {"m": [100, 250, 500, 750, 1000, 2500], "k": [50, 100, 500, 1000, 1500], "max_items": [1, 2, 3, 5, 7, 15, 100]}

#: Clicks of prefixes that a search tries at once.
CLICKS_AT_ONCE = 250_000
#: Sessions on the lists of evolving clicks, counted for each click, that are compared at once.
LISTED_AT_ONCE = 150_000_000
#: Clicks of an evolving session whose lists are compared in one row; sessions with more are compared by joins alone.
PACKED_CLICKS = 200
#: Keys of a semi join are broadcast up to so many.
BROADCAST_KEYS = 1_000_000


def grid(spark: SparkSession, values: dict[str, list[int]]) -> DataFrame:
    """All combinations, one column for each parameter; the lists are parameters, so their product is theirs to bound."""
    out = spark.range(0, 1, 1, 1).drop("id")
    for name, own in values.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v).cast("long") for v in own])).alias(name))
    return out


def combinations(values: dict[str, list[int]]) -> int:
    return reduce(lambda a, b: a * len(b), values.values(), 1)


def random_combinations(spark: SparkSession, values: dict[str, list[int]], n: int, seed: int = 42) -> DataFrame:
    """n of the combinations, at random by seed; all of them if there aren't more."""
    return grid(spark, values).orderBy(F.xxhash64(F.lit(seed), *values)).limit(n)


def _least_over(values: list[int], n: Column) -> Column:
    """The least of the values that is n or more, else the largest: larger ones choose the same of n rows."""
    return F.coalesce(F.get(F.filter(_longs(values), lambda v: v >= n), F.lit(0)), F.lit(values[-1]).cast("long"))


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def search(evolving: DataFrame, history: DataFrame, combos: DataFrame, length: int = 20) -> DataFrame:
    """(m, k, max_items, mrr) of every combination with k <= m; max_items counts from 1.

    Rows carry their m, k and max_items (x): candidates are looked up once, for the largest m. Parameters that can't
    differ for a prefix (no more clicks than x, candidates than m, neighbours than k) are worked out once and stand for each other.
    All sessions are tried. Prefixes whose next item no session can recommend add 0 for certain and are only counted (reachable(), in parts of LISTED_AT_ONCE);
    of the others, parts of about CLICKS_AT_ONCE clicks are worked out one after the other: what a part shuffles is
    removed before the next one begins, and its sums are all that stays.
    """
    names, spark = ["m", "k", "max_items"], evolving.sparkSession
    tried = combos.filter("k <= m").select(*[F.col(c).cast("long").alias(c) for c in names]).distinct()
    ms, ks, xs = tried.agg(*[F.sort_array(F.collect_set(c)) for c in names]).first()
    if not ms:
        return spark.createDataFrame([], "m long, k long, max_items long, mrr double")
    p = replace(KnnParams(), m=ms[-1], n=length)
    in_order = Window.partitionBy("eid").orderBy("pos", "item")
    evolving = stored(evolving.filter("eid IS NOT NULL").select("eid", "item", F.row_number().over(in_order).cast("long").alias("pos")), "evolving")
    pairs = stored(session_items(history), "session-items")
    lists = stored(knn.packed_lists(top_sessions_per_item(pairs, p.m)).withColumn("n", F.size("list")), "recent-lists")
    listed = evolving.groupBy("item").agg(F.count("*").alias("clicks")).join(lists.select("item", "n"), "item").agg(F.coalesce(F.sum(F.col("clicks") * F.col("n")), F.lit(0))).first()[0]
    near = reduce(DataFrame.unionByName, [stored(reachable(own, lists, p.m), "reachable") for own in _dealt(evolving, "eid", listed, LISTED_AT_ONCE)])
    n = evolving.filter("pos > 1").count()
    tests = evolving.join(_few(near.select("eid").distinct()), "eid", "left_semi")
    prefixes = stored(replay.prefixes(tests).join(near.withColumnRenamed("eid", "SessionId"), ["SessionId", "position"]), "prefixes")
    clicks = F.sum(reduce(lambda a, b: a + b, [F.when(F.lit(x) >= F.col("least"), F.least(F.lit(x), F.col("position"))).otherwise(F.lit(0)) for x in xs]))
    clicks = prefixes.agg(F.coalesce(clicks, F.lit(0))).first()[0]
    idf = item_idf(pairs, lists, p.m)
    asked = _few(prefixes.select(F.explode("history").alias("item")).distinct())
    lists = stored(lists.join(asked, "item", "left_semi").select("item", "list"), "asked-lists")
    wanted = lists.select(F.explode("list.sid").alias("sid")).distinct()
    items = pairs.select(F.col("SessionId").alias("sid"), F.col("ItemId").alias("item")).join(wanted, "sid", "left_semi")
    priced = stored(items.join(idf, "item").groupBy("sid").agg(F.collect_list(F.struct("item", "idf")).alias("items")), "priced-sessions")
    sums = [stored(_sums(own, lists, priced, tried, (ms, ks, xs), p), "search-sums") for own in _dealt(prefixes, "SessionId", clicks, CLICKS_AT_ONCE)]
    total = reduce(DataFrame.unionByName, sums).groupBy(*names).agg(F.sum("own").alias("own"))
    mrr = F.coalesce("own", F.lit(0.0)) / F.nullif(F.lit(n), F.lit(0))
    return tried.join(F.broadcast(total), names, "left").select(*names, mrr.alias("mrr"))


def _dealt(rows: DataFrame, session: str, size: int, at_once: int) -> list[DataFrame]:
    """rows by their session in parts, each of about at_once of their size."""
    parts = max(1, -(-size // at_once))
    return [rows.filter(F.pmod(F.xxhash64(session), F.lit(parts)) == i) for i in range(parts)]


def _few(keys: DataFrame) -> DataFrame:
    """keys, which are broadcast if there are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def session_items(history: DataFrame) -> DataFrame:
    """(SessionId, ItemId, Time): each session's distinct items with the session's last time, by one shuffle."""
    items = history.filter("SessionId IS NOT NULL").repartition("SessionId").groupBy("SessionId", "ItemId").agg(F.max("Time").alias("own"))
    return items.select("SessionId", "ItemId", F.max("own").over(Window.partitionBy("SessionId")).alias("Time"))


def reachable(evolving: DataFrame, lists: DataFrame, m: int) -> DataFrame:
    """(eid, position, least): the prefixes whose next item may be recommended, from their last `least` clicks on; no other prefix's can.

    An item is recommended only if a session that holds it is on the list of one of the clicks used. A list of fewer than m sessions has
    all sessions with its item, so that the two items' lists then share a session; next items with longer lists are all kept. Sessions
    are told apart by 32-bit hashes, whose collisions keep more prefixes, never fewer. Most evolving sessions have no two clicks with
    a session in common, and are passed over whole.
    """
    seen = F.transform("list", lambda s: F.hash(s["sid"])).alias("seen")
    rows = split_join(evolving.select("eid", "item", "pos"), lists.select("item", seen), "item", "eid").select("eid", "pos", "seen").repartition("eid")
    packed = rows.withColumn("block", F.floor(F.col("pos") / PACKED_CLICKS)).groupBy("eid", "block").agg(F.collect_list(F.struct("pos", "seen")).alias("clicks"))
    packed = packed.withColumn("blocks", F.count("*").over(Window.partitionBy("eid")))
    every = F.flatten("clicks.seen")
    meets = (F.col("blocks") > 1) | F.exists("clicks", lambda c: F.size(c["seen"]) >= m) | (F.size(F.array_distinct(every)) < F.size(every))
    clicks = packed.filter(meets).select("eid", F.inline("clicks"))
    met = clicks.select("eid", "pos", F.explode("seen").alias("session"))
    met = met.select("eid", "pos", (F.col("pos") - F.lag("pos").over(Window.partitionBy("eid", "session").orderBy("pos"))).alias("least")).filter("least > 0")
    full = clicks.filter((F.size("seen") >= m) & (F.col("pos") > 1)).select("eid", "pos", F.lit(1).cast("long").alias("least"))
    return met.unionByName(full).groupBy("eid", (F.col("pos") - 1).cast("int").alias("position")).agg(F.min("least").alias("least"))


def item_idf(pairs: DataFrame, lists: DataFrame, m: int) -> DataFrame:
    """(item, idf) by sessions: a list of fewer than m sessions says how many an item has, and only the others are counted."""
    total = pairs.agg(F.countDistinct("SessionId").alias("N"))
    df = lists.filter(F.col("n") < m).select("item", F.col("n").cast("long").alias("df"))
    longer = _few(lists.filter(F.col("n") >= m).select("item"))
    counted = pairs.select(F.col("ItemId").alias("item")).join(longer, "item", "left_semi").groupBy("item").agg(F.count("*").alias("df"))
    return df.unionByName(counted).join(F.broadcast(total)).select("item", F.log(F.col("N") / F.col("df")).alias("idf"))


def _sums(prefixes: DataFrame, lists: DataFrame, priced: DataFrame, tried: DataFrame, values: tuple[list[int], ...], p: KnnParams) -> DataFrame:
    """(m, k, max_items, own) of every combination tried: the sum of the reciprocal ranks over these prefixes."""
    (ms, ks, xs), names, length = values, ["m", "k", "max_items"], p.n
    rows = prefixes.withColumn("x", F.explode(F.array_distinct(F.transform(_longs(xs), lambda x: F.least(x.cast("int"), F.col("position")))))).filter("x >= least")
    rows = rows.withColumn("history", F.slice("history", F.col("position") - F.col("x") + 1, F.col("x"))).withColumn("eid", F.concat_ws(":", "SessionId", "position", "x"))
    clicks = rows.select("eid", F.posexplode("history").alias("at", "item")).select("eid", "item", (F.col("at") + 1).cast("long").alias("pos"))
    own, of_m = Window.partitionBy("eid"), Window.partitionBy("eid", "m")
    near = knn.candidates(clicks, None, p, lists).withColumn("r", F.row_number().over(own.orderBy(F.desc("time"), F.desc("sid"))))
    near = near.withColumn("m_top", _least_over(ms, F.count("*").over(own)))
    near = near.withColumn("m", F.explode(F.filter(_longs(ms), lambda m: (m >= F.col("r")) & (m <= F.col("m_top"))))).filter("sim > 0")
    near = near.withColumn("j", F.row_number().over(of_m.orderBy(F.round("sim", 9).desc(), F.desc("time"), F.desc("sid"))))
    near = near.withColumn("k_top", _least_over(ks, F.count("*").over(of_m))).filter("j <= k_top")
    part = DECAYS[p.decay](F.col("step")) * F.col("sim")
    # A neighbour is shuffled once by eid, and unfolded after that.
    sums = near.join(priced, "sid").repartition("eid").select("eid", "m", "m_top", "k_top", "j", "step", "sim", F.inline("items")).groupBy("eid", "m", "m_top", "k_top", "item")
    sums = sums.agg(F.max("idf").alias("idf"), F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.sum(F.when(F.col("j") <= k, part)).alias("s")) for k in ks]).alias("by_k"))
    scores = sums.select("eid", "m", "m_top", "k_top", "item", "idf", F.inline("by_k")).filter("k <= k_top AND s IS NOT NULL").withColumn("score", F.col("s") * F.col("idf"))
    scores = scores.join(rows.select("eid", F.element_at("history", -1).alias("last")), "eid").filter("item != last")
    case = ["eid", "m", "m_top", "k", "k_top"]
    rank = F.row_number().over(Window.partitionBy(*case).orderBy(F.round("score", 9).desc(), F.asc("item")))
    top = scores.withColumn("rank", rank).filter(F.col("rank") <= length).groupBy(*case).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("recs"))
    found = top.join(rows.select("eid", "position", "x", "next_items"), "eid").select(*[F.col(c).alias(f"_{c}") for c in ("m", "m_top", "k", "k_top", "position", "x")], metrics.mrr(F.col("recs"), F.col("next_items"), length).alias("own"))
    same = (F.least("m", "_m_top") == F.col("_m")) & (F.least("k", "_k_top") == F.col("_k")) & (F.least("max_items", "_position") == F.col("_x"))
    return found.join(F.broadcast(tried), same).groupBy(*names).agg(F.sum("own").alias("own"))


def best(results: DataFrame) -> DataFrame:
    """The combination of the largest MRR; of equal ones the smallest parameters."""
    return results.orderBy(F.round("mrr", 9).desc(), "m", "k", "max_items").limit(1)
