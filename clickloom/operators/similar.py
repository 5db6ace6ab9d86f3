"""Similarities of every session with all sessions that share an item, summed up for each, without a row for each pair."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import similarity
from ..session import dealt_out, discard, moved, stored

#: Sessions of more distinct items are compared one by one; shorter ones give a row for each two of their items.
LONG = 64
#: Pairs that are broadcast; more of them are shuffled.
BROADCAST_PAIRS = 500_000
#: All large shuffles but that of the clicks are made in one part for each so many items of sessions, in PARTS at most, one part after the other;
#: those of items and of pairs, which read all classes in each part, in half as many.
PART_ITEMS, PARTS = 4_000_000, 8


def item_sets(clicks: DataFrame) -> DataFrame:
    """(sid, l, items): the distinct items of each session in ascending order, and their number; null ids are in no set."""
    sets = clicks.filter("SessionId IS NOT NULL AND ItemId IS NOT NULL").groupBy(F.col("SessionId").alias("sid")).agg(F.sort_array(F.collect_set("ItemId")).alias("items"))
    return sets.select("sid", F.size("items").alias("l"), "items")


def _classes(sets: DataFrame) -> DataFrame:
    """(sid, l, items, m): of all sessions with the same items the least, and how many they are."""
    return sets.groupBy("items").agg(F.min("sid").alias("sid"), F.count("*").alias("m")).select("sid", F.size("items").alias("l"), "items", "m")


def _copies(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(eid, sid): the sessions that stand for no class, each with the one that does so for its own."""
    return sets.select(F.col("sid").alias("eid"), "items").join(classes.filter("m > 1").select("sid", "items"), "items").filter("eid != sid").select("eid", "sid")


def _parts(sessions: DataFrame) -> int:
    size = sessions.agg(F.coalesce(F.sum("l"), F.lit(0))).first()[0]
    return max(1, min(PARTS, -(-size // PART_ITEMS)))


def _in_parts(part: Callable[[int], DataFrame], parts: int, name: str) -> DataFrame:
    """The rows of all parts, each written (and its shuffles removed) before the next."""
    return reduce(DataFrame.unionByName, [stored(part(i), f"{name}-{i}") for i in range(parts)])


def _sent(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small, so that what it is joined with isn't shuffled."""
    return F.broadcast(table) if table.count() <= BROADCAST_PAIRS else table


def _sums_by_item(rows: DataFrame, kind: str) -> DataFrame:
    """(item, l, n, s, r): of a session of l items, over the other sessions with the item: their number, the sum of the similarities if they
    share nothing else, and the size of the most similar one. Items are counted by size, so that a common one is a few rows."""
    sizes = rows.groupBy("item", "l").agg(F.sum("m").alias("n"))
    of_item = sizes.groupBy("item").agg(F.collect_list(F.struct("l", "n")).alias("sizes"))
    others = of_item.select("item", F.explode("sizes.l").alias("l"), "sizes").select("item", "l", F.explode("sizes").alias("x")).select("item", "l", F.col("x.l").alias("r"), (F.col("x.n") - (F.col("x.l") == F.col("l")).cast("long")).alias("n")).filter("n > 0")
    one = similarity(kind, F.lit(1), F.col("l"), F.col("r"))
    return others.groupBy("item", "l").agg(F.sum("n").alias("n"), F.sum(F.col("n") * one).alias("s"), F.max_by("r", one).alias("r"))


def _sharing_two(classes: DataFrame, parts: int) -> DataFrame:
    """(a, b), a < b: pairs of classes with two common items or more, among a few with less (equal hashes).

    Short sessions meet at a hash of two items, which are dealt to the parts by the lesser. A long one is compared with all that have one of its
    items: if there are few, their items are sent to the others' and not both shuffled.
    """
    firsts = classes.filter((F.col("l") > 1) & (F.col("l") <= LONG)).select("sid", "l", "items", F.posexplode("items").alias("at", "first")).filter("at + 1 < l")

    def met_at_two(part: int) -> DataFrame:
        own = firsts.filter(F.pmod(F.xxhash64("first"), F.lit(parts)) == part)
        own = own.select("sid", "first", F.explode(F.slice("items", F.col("at") + 2, F.col("l"))).alias("second"))
        keys = own.select("sid", F.xxhash64("first", "second").alias("key"))
        return keys.withColumnRenamed("sid", "a").join(keys.withColumnRenamed("sid", "b"), "key").filter("a < b").select("a", "b").distinct()

    short = _in_parts(met_at_two, parts, "pairs-part")
    long = classes.filter(F.col("l") > LONG).select(F.col("sid").alias("x"), F.explode("items").alias("item"))
    size = long.count()
    if not size:
        return short.distinct()
    met = (F.broadcast(long) if size <= BROADCAST_PAIRS else long).join(classes.select(F.col("sid").alias("y"), F.explode("items").alias("item")), "item").filter("x != y")
    met = met.groupBy("x", "y").agg(F.count("*").alias("c")).filter("c > 1").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return short.unionByName(met).distinct()


def _shared(classes: DataFrame, parts: int) -> DataFrame:
    """(sid, c, l, r, m): both ways, the pairs of classes that share c > 1 items, their sizes and the other's sessions; and each class with its own copies."""
    pairs = stored(_sharing_two(classes, parts), "pairs")
    few = pairs.count() <= BROADCAST_PAIRS
    left = classes.select(F.col("sid").alias("a"), F.col("items").alias("own"), F.col("m").alias("ma")).join(F.broadcast(pairs) if few else pairs, "a")
    left = stored(left, "pairs-left")
    right = classes.select(F.col("sid").alias("b"), "items", F.col("m").alias("mb"))
    both = right.join(F.broadcast(left) if few and _items(left) <= BROADCAST_PAIRS * 8 else left, "b")
    found = both.select("a", "b", "ma", "mb", F.size(F.array_intersect("own", "items")).alias("c"), F.size("own").alias("l"), F.size("items").alias("r")).filter("c > 1")
    ways = F.explode(F.array(F.struct(F.col("a").alias("sid"), "c", "l", "r", F.col("mb").alias("m")), F.struct(F.col("b").alias("sid"), "c", F.col("r").alias("l"), F.col("l").alias("r"), F.col("ma").alias("m"))))
    own = classes.filter("l > 1 AND m > 1").select("sid", F.col("l").alias("c"), "l", F.col("l").alias("r"), (F.col("m") - 1).alias("m"))
    return found.select(ways.alias("x")).select("x.*").unionByName(own)


def _items(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0]


def similar_sessions(clicks: DataFrame, kind: str) -> DataFrame:
    """(eid, n, total, most) of each session that shares an item with others: how many, and the sum and largest of their similarities.

    Sessions with the same items have the same row, so one stands for all of its class, and weighs as many. Nearly all pairs of classes
    share one item, and a similarity at one shared item depends on the two sizes alone: it is summed for each item and size, which counts a
    pair once for each item that it shares. The pairs that share more are found as such and put right: no similarity falls when more is
    shared, so the largest needs no correction. The work grows with clicks, items' sizes and pairs of classes that share two items.
    """
    sets = dealt_out(item_sets(clicks).withColumn("part", F.pmod(F.xxhash64("items"), F.lit(PARTS))), "item-sets", "part")
    dealt = _parts(sets)
    set_parts = [sets.filter(F.col("part") % dealt == i).drop("part") for i in range(dealt)]
    class_parts = [stored(_classes(own), f"item-classes-{i}") for i, own in enumerate(set_parts)]
    copies = _in_parts(lambda i: _copies(set_parts[i], class_parts[i]), dealt, "item-copies")
    if dealt > 1:
        discard(sets)
    classes = reduce(DataFrame.unionByName, class_parts)
    parts = _parts(classes)
    fewer = -(-parts // 2)
    value = lambda c: similarity(kind, c, F.col("l"), F.col("r"))
    shared = _shared(classes, fewer)
    more = shared.groupBy("sid").agg(F.sum(F.col("m") * (F.col("c") - 1)).alias("dn"), F.sum(F.col("m") * (F.col("c") * value(F.lit(1)) - value(F.col("c")))).alias("ds"), F.max(value(F.col("c"))).alias("best"))
    more = stored(more, "shared-more")
    rows = classes.select("l", "m", F.explode("items").alias("item"))
    by_item = _in_parts(lambda i: _sums_by_item(rows.filter(F.pmod(F.xxhash64("item"), F.lit(fewer)) == i), kind), fewer, "item-sums")

    def once_of(part: DataFrame) -> DataFrame:
        own = part.select("sid", "l", F.explode("items").alias("item")).join(by_item, ["item", "l"])
        return own.groupBy("sid").agg(F.sum("n").alias("n"), F.sum("s").alias("total"), F.max(value(F.lit(1))).alias("most"))

    if parts > 1:
        once = reduce(DataFrame.unionByName, [moved(once_of(own), f"shared-once-{i}", own) for i, own in enumerate(class_parts)])
        discard(by_item)
    else:
        once = stored(once_of(classes), "shared-once")
    both = once.join(_sent(more), "sid", "left")
    both = both.select("sid", (F.col("n") - F.coalesce("dn", F.lit(0))).alias("n"), (F.col("total") - F.coalesce("ds", F.lit(0.0))).alias("total"), F.greatest("most", "best").alias("most"))
    return both.withColumnRenamed("sid", "eid").unionByName(both.join(_sent(copies), "sid").drop("sid"))
