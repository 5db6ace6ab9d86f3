"""Incremental scores: each micro-batch of clicks recomputes the sessions it touches, and no others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.knn import KnnParams, recommend
from ..session import shared_dir


class IncrementalScores:
    """Recommendations kept up to date with a stream of evolving clicks(eid, item, pos), as Parquet versions in the shared folder.

    The clicks so far and each batch's recommendations are stored by batch id, so that a batch that is run again
    replaces its own output; the newest batch of a session holds its recommendations.
    """

    def __init__(self, history: DataFrame, params: KnnParams) -> None:
        self.history, self.params, self.spark = history, params, history.sparkSession
        self.base = f"{shared_dir(self.spark)}/incremental-{uuid.uuid4().hex}"

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        batch.select("eid", "item", "pos").write.mode("overwrite").parquet(f"{self.base}/clicks/batch={batch_id}")
        clicks = self.spark.read.parquet(f"{self.base}/clicks").filter(F.col("batch") <= batch_id)
        touched = clicks.filter(F.col("batch") == batch_id).select("eid").distinct()
        evolving = clicks.join(touched, "eid", "left_semi").select("eid", "item", "pos")
        scored = recommend(evolving, self.history, self.params)
        touched.join(scored, "eid", "left").write.mode("overwrite").parquet(f"{self.base}/scores/batch={batch_id}")

    def current(self) -> DataFrame:
        """(eid, rank, item, score) of every session as of its last batch."""
        scores = self.spark.read.parquet(f"{self.base}/scores")
        newest = scores.groupBy("eid").agg(F.max("batch").alias("batch"))
        return scores.join(newest, ["eid", "batch"]).filter("rank IS NOT NULL").select("eid", "rank", "item", "score")

    def start(self, clicks: DataFrame) -> StreamingQuery:
        return clicks.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start()


def replay_source(df: DataFrame, path: str, files: int) -> None:
    """Write a table as files that a file stream reads one at a time, by ascending request."""
    df.repartitionByRange(files, "request_id").write.mode("overwrite").parquet(path)
