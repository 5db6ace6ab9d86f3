"""Line dedup: repeated runs of lines, found in the suffix order of line ids by distributed prefix doubling.

Only lines that occur twice can lie in a repeated run. Their places get numbers in the order of the documents, and the
suffixes that start there are ranked by their first line, then by 2, 4, 8 ... lines, each round from the ranks of two halves. Ranks
follow the suffix order, so the suffixes of one rank are an interval of the suffix array with a longest common prefix of at
least so many lines. Descending through the levels, each suffix's longest common prefix with any earlier place is found:
the interval it shares with an earlier suffix is lengthened by half as many lines, a quarter, and so on. A place
whose longest earlier prefix has at least `words` words starts a repeated run; the runs of neighbouring places overlap, and
their union is all maximal repeated runs.

2^k >= `words` lines have `words` words, since lines without words aren't counted. A longer common prefix is the union of those of
so many lines that start in it, so prefixes are told apart up to that length only: log2(words) rounds up and down, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from .rows import numbered
from .skew import join_groups

_TOKEN = r"[^\x20\x09-\x0D]+"
#: Groups of rows, lines or digests that are broadcast; more of them are shuffled.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class LineDedupParams:
    """words: a repeated run of lines counts if it has at least so many."""

    words: int = 50

    @property
    def levels(self) -> int:
        """The last level: 2 to that power is `words` lines or more."""
        return max(0, (self.words - 1).bit_length())


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _lines(rows: DataFrame) -> DataFrame:
    """(row, at, line, words, id) of every line with words: at counts those only, line all; id is the line's 128-bit digest."""
    own = F.transform(_split(F.col("text")), lambda x, i: F.struct(i.cast("int").alias("line"), x.alias("own"), F.regexp_count(x, F.lit(_TOKEN)).cast("int").alias("words")))
    lines = rows.select("row", F.posexplode(F.filter(own, lambda x: x["words"] > 0)).alias("at", "x"))
    return lines.select("row", "at", "x.line", "x.words", _digest(F.col("x.own")).alias("id"))


def _active(lines: DataFrame, p: LineDedupParams) -> DataFrame:
    """(pos, left, row, line, words, upto, id) of the lines that occur twice, in stretches of at least `words` words.

    pos numbers them by row and line, neighbours of a stretch by neighbouring numbers; left counts the stretch's lines from here on,
    upto its words to the end of this line.
    """
    total = lines.count()
    twice = lines.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = join_groups(lines, twice, "id", "n", total).drop("n")
    row = Window.partitionBy("row").orderBy("at")
    stretches = repeated.withColumn("stretch", F.col("at") - F.row_number().over(row))
    own = Window.partitionBy("row", "stretch")
    upto = F.sum("words").over(own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    left = F.count("*").over(own) - F.row_number().over(own.orderBy("at")) + 1
    held = stretches.withColumn("upto", upto).withColumn("left", left).withColumn("all", F.sum("words").over(own)).filter(F.col("all") >= p.words)
    held = stored(held.select("row", "at", "line", "left", "words", "upto", "id"), "stretches")
    placed = held.repartitionByRange("row").sortWithinPartitions("row", "at").withColumn("pos", F.monotonically_increasing_id())
    return stored(placed.drop("at"), "active")


def _ranked(rows: DataFrame, keys: list[str], total: int, name: str) -> DataFrame:
    """(pos, left, rank, first) of the rows whose keys occur twice: rank follows the order of the keys, first is their first place.

    Equal keys are counted before the sort, so a common key is one row of it, and the numbers of a sorted table need no prefix sums.
    total: at least the rows there are.
    """
    one = F.struct(*keys)
    shared = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("pos").alias("first")).filter("n > 1")
    ranks = stored(shared.orderBy(*keys).select(one.alias("key"), "n", "first", F.monotonically_increasing_id().alias("rank")), f"{name}-ranks")
    return stored(join_groups(rows.withColumn("key", one), ranks, "key", "n", total).select("pos", "left", "rank", "first"), name)


def suffix_levels(active: DataFrame, p: LineDedupParams) -> list[DataFrame]:
    """For each level k, (pos, left, rank, first) of the places whose first 2^k lines occur twice."""
    total = active.count()
    levels = [_ranked(active.select("pos", "left", "id"), ["id"], total, "level-0")]
    for k in range(p.levels):
        step = 1 << k
        heads = levels[-1].filter(F.col("left") >= 2 * step).select("pos", "left", F.col("rank").alias("half"))
        tails = levels[-1].select((F.col("pos") - step).alias("pos"), F.col("rank").alias("second"))
        levels.append(_ranked(heads.join(tails, "pos"), ["half", "second"], total, f"level-{k + 1}"))
    return levels


def earlier_prefixes(levels: list[DataFrame]) -> DataFrame:
    """(pos, length): the lines of the longest common prefix of the suffix at pos with one at an earlier place, 2^(last level) at most.

    A place takes part in the interval of its prefix so far, named by its length and first place (node). To lengthen it by 2^j lines,
    the interval's members are grouped by the rank of those lines; a group's first member goes on standing for the others
    in the interval that it leaves, and is copied into the longer one, where the later members compare themselves with it.
    """
    later = stands = None
    for k, level in enumerate(levels):
        own = level.filter("pos > first").select("pos", F.struct(F.lit(k).alias("k"), "first", "left").alias("at"))
        later = own if later is None else later.unionByName(own)
        one = level.filter("pos = first").select("pos", F.lit(k).alias("k"), "left", F.lit(1 << k).alias("length"), F.col("pos").alias("node"), F.lit(False).alias("asks"))
        stands = one if stands is None else stands.unionByName(one)
    start = later.groupBy("pos").agg(F.max("at").alias("at")).select("pos", "at.k", "at.left", F.expr("shiftleft(1, at.k)").alias("length"), F.col("at.first").alias("node"), F.lit(True).alias("asks"))
    state = start.unionByName(stands)
    last, total = len(levels) - 1, 2 * levels[0].count()  # an interval's standing member is a row beside those that ask
    for j in range(last - 2, -1, -1):
        state = stored(state, f"prefixes-{j}")
        state = _lengthened(state, levels[j], j, last, total)
    return state.filter("asks").select("pos", "length")


def _lengthened(state: DataFrame, level: DataFrame, j: int, last: int, total: int) -> DataFrame:
    """state after trying 2^j more lines on the prefixes of levels between j and the last, which is long enough."""
    tries = F.col("k").between(j + 1, last - 1) & (F.col("left") >= F.col("length") + (1 << j))
    ranks = level.select(F.col("pos").alias("next"), "rank")
    trying = state.filter(tries).withColumn("next", F.col("pos") + F.col("length"))
    key = F.struct("length", "node", "rank").alias("key")
    # A place has a rank at the lines that follow only if these occur twice, too.
    known = trying.join(ranks, "next", "left").drop("next").select("*", F.when(F.col("rank").isNotNull(), key).alias("key")).drop("rank")
    groups = known.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("pos").alias("first")).filter("n > 1")
    joined = join_groups(known, groups, "key", "n", total, "left").drop("key", "n")
    goes = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    longer = F.col("length") + (1 << j)
    moved = joined.select("pos", "k", "left", F.when(goes, longer).otherwise(F.col("length")).alias("length"), F.when(goes, F.col("first")).otherwise(F.col("node")).alias("node"), "asks")
    stands = joined.filter("pos = first").select("pos", "k", "left", longer.alias("length"), F.col("pos").alias("node"), F.lit(False).alias("asks"))
    return state.filter(~tries).unionByName(moved).unionByName(stands)


def repeated_lines(rows: DataFrame, params: LineDedupParams | None = None) -> DataFrame:
    """(row, line, id) of every line of rows(row, text) to delete: it lies in a run of at least `words` words that occurs before, too.

    Places are ordered by row, then line; rows must be numbers that aren't null or repeated.
    """
    p = params or LineDedupParams()
    active = _active(stored(_lines(rows), "lines"), p)
    found = earlier_prefixes(suffix_levels(active, p))
    ends = found.select("pos", (F.col("pos") + F.col("length") - 1).alias("end")).join(active.select(F.col("pos").alias("end"), F.col("upto").alias("last_upto")), "end")
    runs = active.join(ends, "pos", "left")
    end = F.when(F.col("last_upto") - F.col("upto") + F.col("words") >= p.words, F.col("end"))
    reach = F.max(end).over(Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("reach", reach).filter("reach >= pos").select("row", "line", "id")


def _differing(rows: DataFrame, gone: DataFrame) -> int:
    """How many digests of deleted lines stand for lines of different bytes."""
    ids = stored(gone.select("id").distinct(), "gone-digests")
    lines = rows.select(F.explode(F.array_distinct(_split(F.col("text")))).alias("own")).withColumn("id", _digest(F.col("own")))
    held = lines.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    return held.groupBy("id").agg(F.min("own").alias("a"), F.max("own").alias("b")).filter("a != b").count()


def dedup_lines(docs: DataFrame, params: LineDedupParams | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_lines, n_removed, removed, clean_text.

    Lines end at \\n; a null text counts as empty, one blank line. A line is deleted if it lies in a run of lines (blank
    lines between them aside) with at least `words` words that occurs before, in doc_id and line order, in this or another
    document; runs may overlap their first copy. Null doc_ids come last; rows that share a doc_id, or have none, are documents of their
    own, in the order of a hash of their texts. removed lists the deleted lines' numbers in order, comma-joined;
    clean_text has the other lines. Other columns aren't read; an empty table gives no rows. Lines are told apart by 128-bit digests;
    the bytes of deleted lines are compared, and the job fails if two different lines share a digest.
    """
    rows = numbered(docs.select("doc_id", "text"), "row")
    gone = stored(repeated_lines(rows, params), "gone")
    if _differing(rows, gone):
        raise RuntimeError("two different lines share a digest")
    lists = stored(gone.groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("gone")), "gone-lines")
    out = rows.join(F.broadcast(lists) if _few(lists) else lists, "row", "left")
    gone_lines = F.coalesce("gone", F.array().cast("array<int>"))
    clean = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_without(_split(F.col("text")), F.col("gone")), "\n"))
    return out.select("doc_id", F.size(_split(F.col("text"))).cast("long").alias("n_lines"), F.size(gone_lines).cast("long").alias("n_removed"), F.array_join(gone_lines.cast("array<string>"), ",").alias("removed"), clean.alias("clean_text"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines whose numbers aren't in gone, which is sorted: a mask is laid beside the lines, so that the work is linear."""
    before = lambda i: F.coalesce(F.get(gone, i - 1), F.lit(-1))
    mask = F.flatten(F.transform(gone, lambda g, i: F.concat(F.array_repeat(F.lit(False), (g - before(i) - 1).cast("int")), F.array(F.lit(True)))))
    beside = F.arrays_zip(lines.alias("line"), mask.alias("out"))
    return F.transform(F.filter(beside, lambda x: ~F.coalesce(x["out"], F.lit(False))), lambda x: x["line"])


def _few(lists: DataFrame) -> bool:
    """Whether the lists of deleted lines are few and short enough to broadcast: at most BROADCAST_IDS rows and lines."""
    n = lists.agg(F.coalesce(F.sum(F.size("gone") + 1), F.lit(0))).first()[0]
    return n <= BROADCAST_IDS
