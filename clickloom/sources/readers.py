"""Sources: click logs, raw events by day, indexes, predictions, settings. Paths are any that Spark's readers open."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.clean import days_before, first_rows
from ..session import stored

CLICK_SCHEMA = "SessionId long, ItemId long, Time double"


def read_clicks(spark: SparkSession, path: str, strict: bool = False, half_even: bool = False, string_sessions: bool = False) -> DataFrame:
    """Tab-separated clicks with a header; Time rounded to seconds. Bad rows are dropped, or fail the read if strict."""
    schema = CLICK_SCHEMA.replace("SessionId long", "SessionId string") if string_sessions else CLICK_SCHEMA
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").csv(path)
    rounded = F.bround("Time") if half_even else F.round("Time")
    # Columns that aren't needed would not be parsed, and their bad values not be seen.
    return rows.filter("SessionId IS NOT NULL AND ItemId IS NOT NULL AND Time IS NOT NULL").withColumn("Time", rounded.cast("long"))


def first_events(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Clicks of a file whose columns are found by name, strictly read; at most so many, the first by time."""
    rows = spark.read.option("sep", "\t").option("header", True).option("mode", "FAILFAST").option("inferSchema", False).csv(path)
    typed = rows.select(*[F.col(c).cast("long").alias(c) for c in ("SessionId", "ItemId", "Time")])
    broken = F.assert_true(F.col("SessionId").isNotNull() & F.col("ItemId").isNotNull() & F.col("Time").isNotNull(), "a click lacks a number")
    checked = typed.filter(broken.isNull())
    return first_rows(checked, most, ["Time", "SessionId", "ItemId"]) if most is not None else checked


def count_rows(spark: SparkSession, path: str, format: str = "parquet") -> int:
    """Rows of all files below the path, from the files' own counts where they have some."""
    return spark.read.format(format).load(path).count()


def read_days(spark: SparkSession, base: str, end_date: str, days: int, format: str = "parquet") -> DataFrame:
    """Events of the end date and so many days before, one folder a day; missing days are skipped."""
    return spark.read.format(format).option("ignoreMissingFiles", True).load([f"{base}/{d}" for d in days_before(end_date, days)])


def read_index(spark: SparkSession, base: str, format: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(item index, session index) below base; Avro needs Spark's avro package."""
    return spark.read.format(format).load(f"{base}/itemindex"), spark.read.format(format).load(f"{base}/sessionindex")


def partition_of(session: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(parts)).cast("int")


def read_clicks_partition(spark: SparkSession, path: str, part: int, parts: int) -> DataFrame:
    """The clicks of the sessions that hash to one of the parts."""
    return read_clicks(spark, path).filter(partition_of(F.col("SessionId"), parts) == part)


def evolving_sessions(clicks: DataFrame) -> DataFrame:
    """SessionId and its items in order of time; clicks of equal time by item."""
    return clicks.groupBy("SessionId").agg(F.transform(F.array_sort(F.collect_list(F.struct("Time", "ItemId"))), lambda x: x["ItemId"]).alias("items"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(recs, next_items) of lines `a,b;c,d`; an empty side is an empty list."""
    side = lambda n: F.transform(F.filter(F.split(F.get(F.split("value", ";"), F.lit(n)), ","), lambda x: x != ""), lambda x: x.cast("long"))
    return spark.read.text(path).select(F.coalesce(side(0), F.array().cast("array<bigint>")).alias("recs"), F.coalesce(side(1), F.array().cast("array<bigint>")).alias("next_items"))


def synthetic_scores(predictions: DataFrame) -> DataFrame:
    """One row for each recommendation with its rank from 1 and the score 1 - 0.001 * (rank - 1)."""
    return predictions.select(F.posexplode("recs").alias("at", "item"), "next_items").select((F.col("at") + 1).alias("rank"), "item", F.round(1 - 0.001 * F.col("at"), 3).alias("score"), "next_items")


def runs_of_sessions(clicks: DataFrame, order: str) -> DataFrame:
    """One row for each run of rows of one session that follow each other in `order`: (SessionId, run, items); run is the place of its first row.

    Rows are numbered by blocks of a range sort, without one task that sorts all. Each block gets two values from the blocks before it:
    how many rows they hold, and where the run starts that its first row continues.
    """
    rows = stored(clicks.repartitionByRange(order).withColumn("__block", F.spark_partition_id()), "session-runs")
    own = Window.partitionBy("__block").orderBy(order, "SessionId", "ItemId")
    rows = rows.withColumn("__place", F.row_number().over(own).cast("long"))
    rows = rows.withColumn("__start", F.when((F.col("__place") > 1) & ~F.lag("SessionId").over(own).eqNullSafe(F.col("SessionId")), F.col("__place")))
    blocks = rows.groupBy("__block").agg(F.count("*").alias("n"), F.min_by("SessionId", "__place").alias("first"), F.max_by("SessionId", "__place").alias("last"), F.max("__start").alias("start"))
    by_block = Window.orderBy("__block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.lag("n").over(by_block).isNull() | ~F.lag("last").over(by_block).eqNullSafe(F.col("first"))
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("opens", opens)
    blocks = blocks.withColumn("start", F.col("__before") + F.coalesce("start", F.when(F.col("opens"), 1)))
    carried = F.when(F.col("opens"), F.col("__before") + 1).otherwise(F.last("start", ignorenulls=True).over(earlier))
    rows = rows.withColumn("__start", F.last("__start", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(F.broadcast(blocks.select("__block", "__before", carried.alias("__carried"))), "__block")
    run = F.coalesce(F.col("__before") + F.col("__start"), F.col("__carried"))
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col("__before") + F.col("__place"), "ItemId"))), lambda x: x["ItemId"])
    return rows.groupBy("SessionId", run.alias("run")).agg(items.alias("items"))


@dataclass(frozen=True)
class Settings:
    training_data_path: str = ""
    num_workers: int = 4
    m_most_recent_sessions: int = 500
    neighborhood_size_k: int = 500
    num_items_to_recommend: int = 21
    max_items_in_session: int = 2
    enable_business_logic: bool = False


_ENV = {"training_data_path": "TRAINING_DATA", "num_workers": "NUM_WORKERS"}


def read_settings(path: str | None = None) -> Settings:
    """A TOML file, whose tables are flattened, over the defaults; environment variables over both."""
    held: dict = {}
    if path:
        with open(path, "rb") as f:
            for key, value in tomllib.load(f).items():
                held |= value if isinstance(value, dict) else {key: value}
    for name, variable in _ENV.items():
        if variable in os.environ:
            held[name] = os.environ[variable].strip("\"'")
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    return Settings(**{k: kinds[k](v) for k, v in held.items() if k in kinds})
