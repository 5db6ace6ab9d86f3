"""Mixing sources to target weights by Efraimidis-Spirakis sampling, as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

#: A token: bytes other than 0x09-0x0D and 0x20.
_TOKEN = r"[^\x20\x09-\x0D]+"
#: Buckets of exponential keys in a source; only one bucket of a source is sorted.
BUCKETS = 1024
#: The least quality weight; the largest is 1.
LEAST_WEIGHT = 0.2
#: Rows of the plan (one for each source and bucket) that are broadcast; a longer plan is shuffled.
BROADCAST_BUCKETS = 200_000


@dataclass(frozen=True)
class MixParams:
    """weights: repeat over the sources in code point order, null last. max_epochs: most times a source's size that it gives.
    seed: of the sampling keys. cut: whether a source's last document gives only the words that its target needs;
    otherwise it is taken whole if that is nearer to the target."""

    weights: tuple[int, ...] = (1, 2, 3)
    max_epochs: int = 3
    seed: int = 17
    cut: bool = True


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("long")


def _source_targets(rows: DataFrame, p: MixParams) -> DataFrame:
    """(source, source_size, target) without gathering the sources: the excess is reshared in at most a few rounds.

    A source is full at level x = target per weight if x * weight > max_epochs * size, that is beyond its own level
    max_epochs * size / weight. With the sources sorted by that level, those below the final level are full, so the
    final level is (total - what the full ones give) / (weights of the others); it is found by a few rounds of one aggregate each.
    """
    sizes = rows.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    sizes = stored(sizes, "source-sizes")
    number = _numbered(sizes)
    k = len(p.weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), (F.col("__nth") % k + 1).cast("int"))
    levels = number.withColumn("__weight", weight).withColumn("__level", p.max_epochs * F.col("source_size") / F.col("__weight"))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level = _final_level(levels, float(total), p.max_epochs)
    target = F.least(F.col("__weight") * F.lit(level), (p.max_epochs * F.col("source_size")).cast("double"))
    return levels.select("__source", "source_size", target.alias("target"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """Sources with __nth, their place in code point order, null last; blocks of a range sort are numbered by their counts."""
    ranged = stored(sizes.repartitionByRange(F.col("__source").isNull(), F.col("__source")).withColumn("__block", F.spark_partition_id()), "source-order")
    blocks = ranged.groupBy("__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("__block", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__block").orderBy(F.col("__source").isNull(), F.col("__source"))) - 1
    return ranged.withColumn("__place", place).join(F.broadcast(blocks), "__block").select("__source", "source_size", (F.col("__before") + F.col("__place")).alias("__nth"))


def _final_level(levels: DataFrame, total: float, max_epochs: int) -> float:
    """The target per weight of the sources that aren't full: each round takes out the sources that are full at the level so far.

    A round is one aggregate; the level only rises, and a round that takes out no source ends the search.
    """
    levels, level, full = stored(levels, "source-levels"), 0.0, -1
    while True:
        over = F.col("__level") < F.lit(level)
        row = levels.agg(F.sum(F.when(over, max_epochs * F.col("source_size"))).alias("given"), F.sum(F.when(~over, F.col("__weight"))).alias("weight"), F.count(F.when(over, 1)).alias("full")).first()
        if row["full"] == full or not row["weight"]:
            return level
        full, level = row["full"], (total - (row["given"] or 0)) / row["weight"]


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight, 0.2 to 1: highest where words are as long as in prose (about six characters with the space)."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) / (F.lit(1.0) + F.abs(F.coalesce(mean, F.lit(0.0)) - 6.5) / 6.5))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the doc_id, so that reruns agree and any SQL engine can follow."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _rows(docs: DataFrame, p: MixParams, keep: list[str]) -> DataFrame:
    """keep, and what the sampling needs of each row: __source, __size, __key, __id, __tie and the key's bucket."""
    rows = docs.select(*keep, F.col("doc_id").alias("__id"), F.col("source").alias("__source"), n_tokens(F.col("text")).alias("__size"), F.xxhash64("text").alias("__tie"), F.col("text").alias("__text"))
    rows = rows.withColumn("__key", -F.log(uniform(F.col("__id"), p.seed)) / quality_weight(F.col("__text"), F.col("__size"))).drop("__text")
    # Keys lie in 0..infinity; rows of the least weight are spread evenly over the buckets, and of any weight up to 1 a bucket holds 1 / LEAST_WEIGHT times an even share at most.
    return rows.withColumn("__bucket", F.least(F.lit(BUCKETS - 1), F.floor(BUCKETS * (1 - F.exp(-LEAST_WEIGHT * F.col("__key"))))).cast("int"))


def _bucket_plan(rows: DataFrame, p: MixParams) -> DataFrame:
    """For each source and bucket: the source's size, target, epochs and need beyond them, and the sizes before and after the bucket."""
    shares = _source_targets(rows, p)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(p.max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    shares = shares.withColumn("__epochs", epochs).withColumn("__need", F.round(F.col("target") - F.col("__epochs") * F.col("source_size")).cast("long"))
    sums = rows.groupBy(F.col("__source").alias("__s"), F.col("__bucket").alias("__b")).agg(F.sum("__size").alias("__sum"))
    after = F.sum("__sum").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("__after", after).withColumn("__before", F.col("__after") - F.col("__sum")).drop("__sum")
    return stored(sums.join(shares, F.expr("__s <=> __source")).drop("__source"), "mix-buckets")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    small = plan.count() <= BROADCAST_BUCKETS
    return rows.join(F.broadcast(plan) if small else plan, F.expr("__source <=> __s AND __bucket = __b")).drop("__s", "__b")


#: A bucket that lies whole below its source's need, and one that lies beyond it.
_WHOLE, _NONE = "__after <= __need", "__before >= __need"


def _edges(rows: DataFrame, p: MixParams) -> DataFrame:
    """The rows of the buckets in which a source's target falls, with __part, the words beyond the epochs."""
    key = Window.partitionBy("__source", "__bucket").orderBy("__key", "__id", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.filter(f"NOT ({_WHOLE} OR {_NONE})").withColumn("__cum", F.col("__before") + F.sum("__size").over(key) - F.col("__size"))
    room = F.least(F.greatest(F.col("__need") - F.col("__cum"), F.lit(0)), F.col("__size"))
    part = room if p.cut else F.when(2 * room >= F.col("__size"), F.col("__size")).otherwise(0)
    return edge.withColumn("__part", part.cast("long")).drop("__cum")


def mix_sources(docs: DataFrame, params: MixParams | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, size, source_size, target, taken.

    size is the number of tokens (null text: 0), target its source's words in the mix, taken the words the mix takes
    from the row: first whole epochs of the source, then rows by ascending exponential key over quality weight until the
    target is met. Null sources are one source, the last. Rows of size 0 give nothing. Equal doc_ids tie; their texts' hashes
    break the tie, and rows equal in both are interchangeable. Other columns aren't read; an empty table gives no rows.
    No source is sorted as a whole: keys are bucketed, bucket sums are prefix-summed, and only the
    bucket in which a source's target falls is sorted.
    """
    p = params or MixParams()
    light = stored(_rows(docs, p, []), "mix-rows")
    rows = _with_plan(light, _bucket_plan(light, p))
    sure = rows.filter(f"{_WHOLE} OR {_NONE}").withColumn("__part", F.when(F.expr(_WHOLE), F.col("__size")).otherwise(0).cast("long"))
    taken = (F.col("__epochs") * F.col("__size") + F.col("__part")).cast("long")
    return sure.unionByName(_edges(rows, p)).select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", taken.alias("taken"))


def mixed_corpus(docs: DataFrame, params: MixParams | None = None) -> DataFrame:
    """The rows of the mix with all columns of docs, each as often as the mix takes it; documents are kept whole.

    The last row of a source is taken if that brings it nearer to its target. Where mix_sources would choose among rows equal
    in doc_id and text, all of them are taken. Texts aren't shuffled: a row is judged by its source, bucket and key.
    """
    p = params or MixParams(cut=False)
    light = stored(_rows(docs, p, []), "mix-rows")
    plan = _bucket_plan(light, p)
    last = _edges(_with_plan(light, plan), p).filter("__part > 0").groupBy(F.col("__source").alias("__ls"), F.col("__bucket").alias("__lb")).agg(F.max(F.struct("__key", "__id", "__tie")).alias("__last"))
    plan = stored(plan.join(last, F.expr("__s <=> __ls AND __b = __lb"), "left").drop("__ls", "__lb"), "mix-last")
    rows = _with_plan(_rows(docs, p, [f"`{c}`" for c in docs.columns]), plan)
    more = F.expr(_WHOLE) | (~F.expr(_NONE) & F.col("__last").isNotNull() & (F.struct("__key", "__id", "__tie") <= F.col("__last")))
    times = F.when(F.col("__size") > 0, F.col("__epochs") + F.when(more, 1).otherwise(0)).otherwise(0).cast("int")
    return rows.withColumn("__times", times).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[f"`{c}`" for c in docs.columns])
