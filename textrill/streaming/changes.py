"""A change feed as a stream: each micro-batch is applied to the store before the next is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textrill.engine import SearchEngine
from textrill.operators import ops
from textrill.runtime import materialize


def apply_to(engine: SearchEngine) -> Callable[[DataFrame, int], None]:
    def batch(changes: DataFrame, _epoch: int) -> None:
        # the stream's rows are read several times; a durable copy survives a lost executor
        changes = materialize(changes, "micro-batch")
        if not changes.isEmpty():
            engine.index(changes)

    return batch


def start(engine: SearchEngine, changes: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Indexes a stream of changes; a search after a batch sees all of it."""
    writer = changes.writeStream.foreachBatch(apply_to(engine)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def only(events: DataFrame, kind: str = "files") -> DataFrame:
    """Events of one subject whose content has not been filled in yet."""
    wanted = F.col("provider_id") == kind
    return events.filter(wanted & F.col("content").isNull()) if "content" in events.columns else events.filter(wanted)


COLUMNS = "provider_id string, document_id string, change_id long, op string, title string, modified long, received_at timestamp_ntz"
ORDER = ["received_at", "change_id"]
JOIN_EVERY = 16


def _epochs(epoch: int) -> range:
    """The epochs whose folders together hold the state after ``epoch``: the last joined one and those after it."""
    return range(max(0, (epoch + 1) // JOIN_EVERY * JOIN_EVERY - 1), epoch + 1)


def state_after(spark: SparkSession, state_folder: str, epoch: int) -> DataFrame:
    """The last operation of each document after a micro-batch."""
    return ops.last_wins(spark.read.schema(COLUMNS).parquet(*[f"{state_folder}/{e}" for e in _epochs(epoch)]), ORDER)


def latest(changes: DataFrame, state_folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last operation of each document of a stream.

    A micro-batch writes its own documents only; every ``JOIN_EVERY``-th joins what came since the
    last joined one, so the state is not written anew for each batch.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        now = rows.select(*[c.split()[0] for c in COLUMNS.split(", ")])
        if (epoch + 1) % JOIN_EVERY == 0 and epoch > 0:
            now = now.unionByName(spark.read.schema(COLUMNS).parquet(*[f"{state_folder}/{e}" for e in _epochs(epoch - 1)]))
        # a repeated epoch writes the same folder again
        ops.last_wins(now, ORDER).write.mode("overwrite").parquet(f"{state_folder}/{epoch}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
