"""Structured Streaming: a folder of log segments imported as they arrive, each event once, with a snapshot after every batch that adds something."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodequarry.operators import context
from lodequarry.sources import inference_log


def follow(spark: SparkSession, folder: str, store: str, checkpoint: str, published: Callable[[DataFrame, int], None] | None = None, every: str | None = None, files: int = 100) -> StreamingQuery:
    """Import segments of a folder into a store. `every` is the polling interval; without it, what is there is imported and the query ends.

    Late and repeated events are accepted: the store holds each once, and spans are made anew from all of it. The file source does not see bytes appended to a file
    it has read; segments must be complete when they appear under their names."""

    def land(batch: DataFrame, number: int) -> None:
        got = inference_log.import_batch(store, batch)
        if got["new"] and published:
            published(spans(batch.sparkSession, store), number)

    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(folder)
    writer = lines.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def spans(spark: SparkSession, store: str) -> DataFrame:
    """The spans of all events imported so far; open, missing_start or finished."""
    return context.spans(inference_log.span_events(spark.read.parquet(store)))
