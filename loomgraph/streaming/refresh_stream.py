"""Streaming forms of maintenance: files that arrive refresh a snapshot; saves are debounced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """A stream of (path, content) for files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content")


def refresh_on_arrival(files: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls refresh(batch, batch_id) for each micro-batch; a batch may come again after a failure
    with the same id, so refresh has to be idempotent for an id."""
    return files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced_saves(events: DataFrame, root: str = "root", at: str = "ts", gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Trailing-edge debounce of save events: a row for each burst of a root, once the watermark has
    passed its end; events later than `late` are dropped, which bounds the state."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return maintenance.debounced(timed, root, at, gap)
