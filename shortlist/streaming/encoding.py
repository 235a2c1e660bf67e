"""Streaming encoding with the ids in the stream's own state, and its progress (M2, M3).

Ids that have passed are kept in the state store of the query, partitioned by id, so a batch is compared with its own
share of them and never with all stored vectors. An id that is delivered again, in the same batch, in a later one or
after a restart from the checkpoint, is encoded once. Vectors that were stored before the stream began are left out by a join
with their ids. Large states belong in RocksDB (``spark.sql.streaming.stateStore.providerClass``), a setting of the session.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from shortlist.operators import retrieval

METRICS = "encoding"


def new_ids(arrivals: DataFrame, known: DataFrame | None = None, id_col: str = "candidate_id", text_col: str = "embedding_text") -> DataFrame:
    """The first arrival of every id that ``known`` lacks, with counts observed on the way. Rows without an id are dropped."""
    fresh = arrivals.where(F.col(id_col).isNotNull())
    fresh = fresh.observe(METRICS + "_arrived", F.count(F.lit(1)).alias("rows"))
    if known is not None:
        fresh = fresh.join(known.select(id_col).distinct(), id_col, "left_anti")
    fresh = fresh.dropDuplicates([id_col])
    return fresh.observe(METRICS, F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("characters"))


def embed_stream(arrivals: DataFrame, store: str, checkpoint: str, known: DataFrame | None = None, encoder: retrieval.Encoder | None = None,
                 id_col: str = "candidate_id", text_col: str = "embedding_text", make=None) -> StreamingQuery:
    """M2: encode what has arrived and stop. A batch writes its own folder, so a repeated batch replaces what it wrote.

    ``encoder`` works as in ``retrieval.encode``; ``make`` instead builds the vector as a Column of the text.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        made = batch.select(id_col, make(F.col(text_col)).alias("embedding")) if make else retrieval.encode(batch, encoder, id_col, text_col)
        made.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")

    return (
        new_ids(arrivals, known, id_col, text_col)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class ProgressLog(StreamingQueryListener):
    """M3: per batch of one query its input rows, the ids in the state and the observed counts; a row per batch is kept."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.ended = threading.Event()
        self.run: str | None = None

    def follow(self, query: StreamingQuery) -> None:
        self.run = str(query.runId)
        self.ended.clear()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        arrived, new = (p.observedMetrics.get(name) for name in (METRICS + "_arrived", METRICS))
        states = sum(s.numRowsTotal for s in p.stateOperators)
        if new is not None:
            self.rows.append((str(p.runId), p.batchId, arrived["rows"] if arrived else 0, new["ids"], new["characters"], states))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self.run is None or str(event.runId) == self.run:
            self.ended.set()

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "run string, batch_id long, arrived long, ids long, characters long, ids_in_state long")
