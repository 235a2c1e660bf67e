"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Settings the operators were tuned with. On a cluster the submit command decides the number of
#: shuffle partitions; adaptive execution coalesces small ones and splits skewed ones.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "shortlist", cores: str = "*", memory: str = "16g", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process. ``local-cluster[...]`` has executors of its own."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str | None:
    """The folder every executor can reach, as named by the session.

    Only a single-machine session without the setting gets a folder of its own; on a cluster
    without the setting there is none, and callers keep the lazy plan instead of writing.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not is_local(spark):
        return None
    folder = tempfile.mkdtemp(prefix="shortlist-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan with at least one partition per core.

    A single small file is read by a single task, which would then do all the work on its
    texts. Scans that already have enough partitions, as any large table does, are left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def checkpointing(spark: SparkSession) -> None:
    """Let iterative learners cut their lineage in the shared folder."""
    folder = shared_folder(spark)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def scratch(spark: SparkSession, name: str) -> str | None:
    """A new path in the shared folder for a table that goes when the driver's interpreter ends; None without a shared folder."""
    folder = shared_folder(spark)
    if folder is None:
        return None
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:  # the session has ended before
        return
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table.

    Used where several consumers need the same expensive result: the scan prunes columns,
    starts with a short lineage, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if path is None:
        return df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_for(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``staged`` for the length of a block: what was written goes when the block ends, so that repeated steps don't add up on disk."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if path is None:
        yield df
        return
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _remove(spark, path)
