"""What the operators share: inputs, staged tables in the shared folder, and small task helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For ``str.translate``: lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def held_out(doc_id, folds: int, fold: int) -> bool:
    """Whether a row is kept back from learning: crc32 of its id as text, a null id counting as empty."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def is_held_out(column: str, folds: int, fold: int) -> Column:
    """``held_out`` as a column."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds == fold


class Stage:
    """Tables that one run of an operator writes to the folder named by ``spark.checkpoint.dir``.

    A written table cuts the lineage, is read by every executor, and survives the loss of the ones
    that made it. ``drop`` removes a table once its consumers have been written; what a returned
    frame still reads goes when the driver's interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not folder:
            raise ValueError(f"{name} needs a folder that all executors share: set spark.checkpoint.dir")
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.remove, self.folder)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self.remove(f"{self.folder}/{name}")

    def remove(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None:
            return
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def few_parts(df: DataFrame) -> DataFrame:
    """Narrow rows in a few parts a core, however many partitions a shuffle has: each part costs a task and a file."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


#: Rows per batch between the JVM and Python where the session's configuration names no number.
BATCH_ROWS, BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts are held on both sides of a task at once, so they are kept small unless the user decides."""
    if not spark.sparkContext.getConf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def release() -> None:
    """Give freed memory back to the machine. Workers live on between the tasks and stages of a session."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def per_row(
    df: DataFrame, schema: str, rows: Callable[[dict[str, list]], dict[str, list]] | None = None, *,
    setup: Callable[[], Callable[[dict[str, list]], dict[str, list]]] | None = None, step: int = 512,
) -> DataFrame:
    """Map the columns of ``df``, as Python lists of at most ``step`` rows, to the columns of ``schema``.

    ``setup`` runs once per task and returns the mapping. Memory is bounded by one Arrow batch,
    whose bytes Spark limits, and the results of ``step`` rows.
    """
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    names = spark_schema.names

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(spark_schema)
        mapping = setup() if setup else rows
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                made = mapping({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[n], arrow.field(n).type) for n in names], schema=arrow)
        mapping = batch = part = made = None
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(task, schema)


def keep_rows(df: DataFrame, text: str, setup: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows whose text the predicate accepts, with all their columns; ``setup`` runs once per task."""
    at = df.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = setup()
        for batch in batches:
            yield batch.filter(pa.array([accepts(t) for t in batch.column(at).to_pylist()], pa.bool_()))
        accepts = batch = None
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(task, df.schema)
