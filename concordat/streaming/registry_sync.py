"""Incremental processing: new files drive the registry's status machine.

The studied tool skips work that is already registered. As a stream: a file
source discovers new documents exactly once (checkpointed), and every
micro-batch applies a latest-wins upsert that is safe to repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concordat.operators.registry import Registry

UPDATES = ("work_id string, pdf_sha256 string, source_path string, doi string, title string, publication_year int, "
           "status string, parser_version string, error_message string, updated_at timestamp")


def read_updates(spark: SparkSession, folder: str, *, max_files: int = 1000) -> DataFrame:
    """Registration events landing as JSON lines."""
    return spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", max_files).json(folder)


def sync_registry(updates: DataFrame, registry: Registry, checkpoint: str, *,
                  available_now: bool = True) -> StreamingQuery:
    """Apply registration events to the registry, batch by batch."""
    def apply(batch: DataFrame, _: int) -> None:
        registry.upsert_documents(batch)

    writer = updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def process_pending(candidates: DataFrame, registry: Registry, work: Callable[[DataFrame], DataFrame], checkpoint: str, *,
                    reached: str = "PARSED", available_now: bool = True) -> StreamingQuery:
    """Run ``work`` on streamed candidates that are not registered as done.

    ``work`` returns ``work_id, error_message``; a record with a message is
    marked ERROR, the others reach ``reached``. A repeated batch finds its
    records done and does nothing.
    """
    done = tuple(s for s in ("PARSED", "CHUNKED", "INDEXED"))

    def apply(batch: DataFrame, _: int) -> None:
        todo = registry.pending(batch, done)
        outcome = work(todo).withColumns({
            "status": F.when(F.col("error_message").isNull(), reached).otherwise("ERROR"),
            "updated_at": F.current_timestamp()})
        registry.set_status(outcome.select("work_id", "status", "error_message", "updated_at"))

    writer = candidates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
