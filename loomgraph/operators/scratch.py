"""Tables written to the folder that all executors see, which cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _sweep() -> None:
    for spark, path in _scratch:
        try:
            delete(spark, path)
        except Exception:  # the session has already gone; the folder is left to its owner
            pass


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; one is made only where the session names none and
    everything runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        base = spark.sparkContext.getCheckpointDir() or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        base = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    if not _scratch:
        atexit.register(_sweep)
    path = f"{shared_folder(spark).rstrip('/')}/loomgraph-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch = path
    return written


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing refers to any more, all that came of them having
    been written itself."""
    for df in tables:
        delete(df.sparkSession, df.scratch)
