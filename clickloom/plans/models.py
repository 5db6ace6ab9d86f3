"""Models with fit and predict over the one kNN plan, and the index job."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, index, rules
from ..operators.knn import VARIANTS, KnnParams, item_scores, neighbours, recommend, top_items, without_seen
from ..session import stored
from ..sources import readers, sinks


class SessionKnn:
    """A fitted history and the parameters of a variant; all evolving sessions are scored in one plan."""

    def __init__(self, variant: str | KnnParams = "serving") -> None:
        self.params = VARIANTS[variant] if isinstance(variant, str) else variant
        self.history: DataFrame | None = None
        self.flags: DataFrame | None = None

    def fit(self, clicks: DataFrame, flags: DataFrame | None = None) -> SessionKnn:
        self.history, self.flags = clicks, flags
        return self

    def extend(self, finished: DataFrame) -> SessionKnn:
        """Add the clicks of finished sessions to the history."""
        self.history = self.history.unionByName(finished)
        return self

    def find_neighbours(self, evolving: DataFrame) -> DataFrame:
        return neighbours(evolving, self.history, self.params)

    def idf(self) -> DataFrame:
        return index.item_idf(self.history, self.params.idf)

    def items_for_session(self, sessions: DataFrame) -> DataFrame:
        return self.history.join(sessions, "SessionId", "left_semi").select("SessionId", "ItemId").distinct()

    def find_attributes(self) -> DataFrame | None:
        return self.flags

    def predict(self, evolving: DataFrame, business_rules: bool = False) -> DataFrame:
        """(eid, rank, item, score); rules are applied before the best are picked."""
        if not business_rules:
            return recommend(evolving, self.history, self.params)
        scores = without_seen(item_scores(self.find_neighbours(evolving), self.history, self.params), evolving, self.params.remind)
        current = evolving.groupBy("eid").agg(F.max_by("item", "pos").alias("item"))
        return top_items(rules.passes_rules(scores, current, self.flags), self.params.n)


class EvolvingKnn:
    """Evolving sessions held as a table over a fitted model: clicks are added, and sessions end, in batches."""

    def __init__(self, model: SessionKnn, evolving: DataFrame) -> None:
        self.model, self.evolving = model, evolving

    def add(self, clicks: DataFrame) -> EvolvingKnn:
        """Append clicks(eid, item, pos); their places follow those of their session."""
        ends = self.evolving.groupBy("eid").agg(F.max("pos").alias("__end"))
        placed = clicks.join(ends, "eid", "left").select("eid", "item", (F.col("pos") + F.coalesce("__end", F.lit(0))).alias("pos"))
        return EvolvingKnn(self.model, stored(self.evolving.select("eid", "item", "pos").unionByName(placed), "evolving"))

    def clear(self, ended: DataFrame) -> EvolvingKnn:
        """Delete the sessions in ended(eid)."""
        return EvolvingKnn(self.model, stored(self.evolving.join(ended, "eid", "left_anti"), "evolving"))

    def ages(self) -> DataFrame:
        """(eid, item, pos, age): age is 0 for a session's newest click."""
        newest = self.evolving.groupBy("eid").agg(F.max("pos").alias("__end"))
        return self.evolving.join(newest, "eid").select("eid", "item", "pos", (F.col("__end") - F.col("pos")).alias("age"))

    def predict_next(self, skip: DataFrame | None = None) -> DataFrame:
        """(eid, rank, item, score) of all sessions but those in skip(eid)."""
        asked = self.evolving if skip is None else self.evolving.join(skip, "eid", "left_anti")
        return self.model.predict(asked)


def build_indexes(events: DataFrame, catalog: DataFrame | None, m: int = 500, gap: int = 1200) -> tuple[DataFrame, DataFrame]:
    """(item index, session index) of raw events: relevant, buyers', sessionized, deduplicated, supported, not overlong clicks."""
    clicks = clean.sessionize(clean.buyers_clicks(clean.as_clicks(clean.relevant_events(events))), gap)
    kept = stored(index.clean_index_input(clicks), "index-clicks")
    ids = clean.dense_ids(kept, "SessionId", "SessionIndex")
    numbered = stored(kept.join(ids, "SessionId").select(F.col("SessionIndex").alias("SessionId"), "ItemId", "Time"), "index-numbered")
    items = index.item_index(numbered, m)
    if catalog is not None:
        items = index.flagged_index(items, index.catalog_flags(catalog, items))
    return items, index.session_index(numbered).withColumnRenamed("SessionId", "SessionIndex")


def main(argv: list[str] | None = None) -> None:
    """The index job: read days of events and a catalog, write both indexes."""
    args = argparse.ArgumentParser(description=main.__doc__)
    for name in ("catalog_dir", "lookback_days", "end_date", "input_dir", "output_dir"):
        args.add_argument(name)
    args.add_argument("--format", default="parquet")
    args.add_argument("--sample-item", type=int)
    a = args.parse_args(argv)
    spark = SparkSession.builder.appName("index-job").getOrCreate()
    items, sessions = build_indexes(readers.read_days(spark, a.input_dir, a.end_date, int(a.lookback_days), a.format), spark.read.format(a.format).load(a.catalog_dir))
    items = stored(items, "item-index")
    sinks.write_index(items, sessions, a.output_dir, format=a.format)
    if a.sample_item is not None:
        sinks.write_index(*index.seed_subgraph(items, a.sample_item), f"{a.output_dir}/sample", 2, a.format)


if __name__ == "__main__":
    main()
