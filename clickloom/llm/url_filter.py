"""URL filters by a sort-merge range join of reversed-host keys, as a DataFrame plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from .skew import join_groups

#: The production rules: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Ends the host in a key; sorts before any other character that a host can have.
_END = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The verdict where no rule fits.
DEFAULT_VERDICT = "allow"


def rule_frame(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first :// up to / ? # or end, A-Z lower-cased; path up to ? # or end; else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _reversed(host: Column) -> Column:
    """a.b.c as c.b.a. with a closing dot, so that a host's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _suffix_keys(host: Column, path: Column, labels: int, width: int) -> Column:
    """A key for each suffix of up to so many labels: the reversed suffix, the end mark and the path, in which a rule's key is a prefix.

    A key is cut at `width` characters, the longest rule's; so a long host or path makes no more and no longer keys than the rules need.
    """
    ends = F.slice(F.reverse(F.split(host, r"\.", -1)), 1, labels)
    key = lambda n: F.substring(F.concat(F.array_join(F.slice(ends, 1, n), "."), F.lit("." + _END), F.substring(path, 1, width)), 1, width)
    return F.transform(F.sequence(F.lit(1), F.size(ends)), key)


def _stacks(rules: DataFrame) -> DataFrame:
    """key and `stack`: the rule of that key and those whose keys are prefixes of it, shortest first.

    A rule's prefixes are looked up by equality, at the lengths that occur among the rules of its host.
    """
    host = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER)
    rules = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host != ''").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rules = rules.withColumn("key", F.concat(_reversed(F.col("host")), F.lit(_END), F.col("path"))).withColumn("rule", F.concat("host", "path"))
    entry = F.struct(F.length("key").alias("width"), "key", F.length("rule").alias("length"), F.length("host").alias("host"), "rule", "verdict")
    widths = rules.groupBy("host").agg(F.collect_set(F.length("key")).alias("widths"))
    fitting = F.filter("widths", lambda n: n <= F.length("key"))
    probes = rules.join(widths, "host").select("key", F.explode(F.transform(fitting, lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("prefix"))
    return probes.join(rules.select(F.col("key").alias("prefix"), entry.alias("entry")), "prefix").groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per row of pages(page_id, url): page_id, host, path, rule, verdict.

    rules(verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's; the longest
    host + path wins, of equally long ones the longer host; of repeated rules the first verdict in code point order
    counts. rule is null and the verdict the default where none fits; a null url or one without :// has an empty host and path.
    Repeated and null page_ids are returned as they are; other columns aren't read; an empty table gives no rows, and without rules the
    default is the verdict. The work for a url is bounded by the labels and the length of the longest rule, whatever its host's length.

    Every suffix of a url's host, with its path, is a key; a rule is the interval of keys that begin with its own. Rules and
    url keys are sorted together over range partitions; the sweep passes on the rule opened last, with the stack of rules
    that enclose it, within a partition by a running window and between partitions by one row for each. The innermost
    rule still active is the last one on that stack that is a prefix of the key. Equal urls are swept once.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    stacks = stored(_stacks(rules), "rule-stacks")
    # The longest rule bounds the keys of all urls.
    labels, width = stacks.agg(F.max(F.size(F.split(F.substring_index("key", _END, 1), r"\.", -1)) - 1), F.max(F.length("key"))).first()
    opens = stacks.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), "stack")
    urls = stored(rows.groupBy("url", "host", "path").agg(F.count("*").alias("n")), "urls")
    probes = urls.filter("host != ''").select("url", F.explode(_suffix_keys(F.col("host"), F.col("path"), labels or 1, width or 1)).alias("key"))
    probes = probes.select("key", F.lit(1).alias("kind"), "url", F.lit(None).cast(opens.schema["stack"].dataType).alias("stack"))
    sweep = stored(opens.unionByName(probes).repartitionByRange("key", "kind", "url").withColumn("block", F.spark_partition_id()), "url-sweep")
    ends = sweep.groupBy("block").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    carried = F.last("last", True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    running = F.last("stack", True).over(Window.partitionBy("block").orderBy("key", "kind", "url").rowsBetween(Window.unboundedPreceding, 0))
    active = sweep.withColumn("open", running).filter("kind = 1").join(F.broadcast(ends.select("block", carried.alias("carried"))), "block")
    fits = F.filter(F.coalesce("open", "carried"), lambda r: F.col("key").startswith(r["key"]))
    innermost = active.select("url", F.try_element_at(fits, F.lit(-1)).alias("r")).filter("r IS NOT NULL")
    # A url has a candidate for each suffix of its host; the longest wins.
    best = innermost.groupBy("url").agg(F.max_by("r", F.struct("r.length", "r.host")).alias("r"))
    total = urls.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    judged = join_groups(rows, urls.select("url", "n").join(best, "url"), "url", "n", total, "left")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
