"""Exact deduplication over a log-structured merge index of digests, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .skew import join_groups, salts

#: Copies of one text whose bytes one task compares with those of the text that stays.
VERIFY_ROWS = 2000
#: Groups whose digests (32 bytes each) are broadcast; more of them are shuffled.
BROADCAST_GROUPS = 500_000
#: The filter of a file is as large as its digests need, not as the largest allowed.
_BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: Folders of a run, by the first bits of the digest.
SHARDS = 16
#: Digests that one look-up asks for; Spark pushes longer lists down as a range only.
_ASKED = 10


class DigestIndex:
    """Sorted runs of (digest, id, rows), each stored with Bloom filters, merged by compaction.

    flush() turns a batch of documents into a run: each task's hash table of partial aggregates is the memtable, and the
    run is sorted by digest within its files, one folder a shard of the digests. compact() merges all runs into one, keeping each
    digest's smallest identifier (or largest) and its number of rows. lookup() finds digests in all runs: it reads the folders of their
    shards alone, and there the parts of files whose least and largest digest and Bloom filter may have them.
    """

    def __init__(self, spark: SparkSession, keep: str = "smallest") -> None:
        if keep not in ("smallest", "largest"):
            raise ValueError(keep)
        self.spark, self.keep, self.runs = spark, keep, []

    def _best(self, c: str) -> Column:
        return F.min(c) if self.keep == "smallest" else F.max(c)

    def _written(self, run: DataFrame, name: str) -> DataFrame:
        """Dealt to tasks in the order of the digests, so that a task writes to a folder or two and not to all of them."""
        dealt = run.withColumn("shard", _shard(F.col("digest"))).repartitionByRange("shard", "digest")
        return stored(dealt.sortWithinPartitions("shard", "digest"), name, ["shard"], **_BLOOM)

    def flush(self, digests: DataFrame) -> None:
        """Add digests(digest, doc_id) as a run."""
        run = digests.groupBy("digest").agg(self._best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        self.runs.append(self._written(run, "digest-run"))

    def compact(self) -> DataFrame:
        """Merge all runs into one; a single run is already compact."""
        if len(self.runs) > 1:
            self.runs = [self._written(self._merged(self.runs), "digest-level")]
        return self.runs[0].drop("shard")

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        return merged.groupBy("digest").agg(self._best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """(digest, keep_id, group_size) of those digests that the index has, as after a compaction."""
        if not digests:
            return self._merged(self.runs).limit(0)
        hits = []
        for lo in range(0, len(digests), _ASKED):
            some = digests[lo : lo + _ASKED]
            asked = F.col("shard").isin(sorted({d[0] * SHARDS // 256 for d in some})) & F.col("digest").isin([bytearray(d) for d in some])
            hits += [run.filter(asked) for run in self.runs]
        return self._merged(hits)


def _shard(digest: Column) -> Column:
    """The digest's first byte, scaled to SHARDS."""
    return F.floor(F.conv(F.hex(F.substring(digest, 1, 1)), 16, 10).cast("int") * SHARDS / 256).cast("int")


def text_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the 32-byte SHA-256 of the whole text, a null text counting as empty."""
    return docs.select(F.col("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"))


def _differing(docs: DataFrame, found: DataFrame, total: int) -> int:
    """How many hits' bytes differ from those of the text that stays in their group."""
    groups = stored(found.filter(F.col("group_size") > 1).groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")), "groups")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).withColumn("digest", F.unhex(F.sha2(F.col("__text").cast("binary"), 256)))
    if groups.count() <= BROADCAST_GROUPS:
        copies = texts.join(F.broadcast(groups), "digest")
    else:
        copies = join_groups(texts, groups, "digest", "group_size", total)
    copies = copies.withColumn("__parts", salts(F.col("group_size"), VERIFY_ROWS))
    # A group's text is dealt to as many parts as the group has, and every copy to one of them.
    stays = copies.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "__parts").agg(F.max("__text").alias("__stays"))
    stays = stays.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    dealt = copies.select("digest", "__text", F.pmod(F.xxhash64("doc_id"), F.col("__parts")).cast("int").alias("__part"))
    return dealt.join(stays, ["digest", "__part"]).filter(F.col("__text") != F.col("__stays")).count()


def dedup_exact(docs: DataFrame, keep: str = "smallest", generations: int = 4) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if all their bytes are; a null text counts as empty. Of equal texts, the row with the smallest (or
    largest) doc_id stays; of rows that share that doc_id too, one stays; a row with a null doc_id stays only if its
    group has no other doc_id. Other columns aren't read; an empty table gives no rows. The digests arrive in
    `generations` memtables, each flushed as a sorted run and merged by compaction. Rows that hit a group are verified
    byte by byte against the text that stays, in salted parts of VERIFY_ROWS copies; the job fails if two different
    texts share a digest.
    """
    spark = docs.sparkSession
    generation = F.pmod(F.xxhash64("doc_id"), F.lit(generations)).alias("generation")
    digests = stored(text_digests(docs).select("*", generation, F.monotonically_increasing_id().alias("__row")), "digests", ["generation"])
    index = DigestIndex(spark, keep)
    for g in range(generations):
        index.flush(digests.filter(F.col("generation") == g))
    total = digests.count()
    found = stored(join_groups(digests.drop("generation"), index.compact(), "digest", "group_size", total), "found")
    if _differing(docs, found, total):
        raise RuntimeError("two different texts share a SHA-256 digest")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    twice = found.filter(stays & (F.col("group_size") > 1)).groupBy("digest").agg(F.min("__row").alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    out = found.join(twice, "digest", "left") if twice.count() > BROADCAST_GROUPS else found.join(F.broadcast(twice), "digest", "left")
    kept = stays & (F.col("__first").isNull() | (F.col("__first") == F.col("__row")))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one_of_each(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs(doc_id, text, ...) that stay, with all their columns; rows with equal doc_id and text count as copies, too.

    Null texts count as empty, and one empty text stays; a null doc_id stays only where a group has no other; an empty table stays empty.
    """
    names = [f"`{c}`" for c in docs.columns]
    judged = dedup_exact(docs, keep)
    gone = stored(judged.filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest")).distinct(), "gone")
    kept_twice = judged.filter("kept AND group_size > 1").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest"))
    clash = gone.join(kept_twice, (gone["__id"].eqNullSafe(kept_twice["__id"])) & (gone["__digest"] == kept_twice["__digest"]), "left_semi").count()
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    marked = docs.select(*names, digest.alias("__own"))
    if clash:  # rows that are equal in doc_id and text: one of them stays
        once = marked.dropDuplicates(["doc_id", "__own"])
        gone = gone.join(kept_twice.distinct(), ["__id", "__digest"], "left_anti")
        marked = once
    small = gone.count() <= BROADCAST_GROUPS
    other = F.broadcast(gone) if small else gone
    return marked.join(other, (F.col("doc_id").eqNullSafe(F.col("__id"))) & (F.col("__own") == F.col("__digest")), "left_anti").select(*names)
