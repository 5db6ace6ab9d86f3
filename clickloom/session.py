"""Spark sessions and the folder that a cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The driver's heap is collected after a write when the part of its limit that it takes from the system is larger.
HEAP_SHARE = 0.5


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "clickloom") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("CLICKLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; where that is unset in a local session, as in tests, a local one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back, so that a lost executor costs no recomputation.

    The write's shuffle files are removed when it ends, and not only when the driver happens to collect its garbage. The driver's heap is
    given back then, too, if it has grown.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, held) if held is not None else spark.conf.unset(_CLEANUP)
    _collect(spark)
    return spark.read.schema(df.schema).parquet(path)


def _collect(spark: SparkSession) -> None:
    """Have the driver drop plans, broadcasts and classes of the writes before, and return their memory.

    A job of hundreds of small plans makes much garbage and holds little, but its heap grows to the limit rather than be collected.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def dealt_out(df: DataFrame, name: str, column: str) -> DataFrame:
    """stored(), with a folder for each value of the column, so that a filter on it reads only that folder."""
    return stored(df, name, [column])


def moved(df: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """stored(), after which the files of the table go that df was made from, and that nothing else reads."""
    out = stored(df, name)
    discard(table)
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a table from stored() that no plan reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)
