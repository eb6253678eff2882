"""Streams of records: incremental ingestion into a store and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.store import SnapshotStore


def record_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sync_store(stream: DataFrame, store: SnapshotStore, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Upsert the records of a stream into a store, batch by batch, until all files there are read.

    A batch that is repeated after a failure writes the same records again, so nothing is lost or doubled. Records that
    vanish from the source don't show in a stream; prune them by :func:`tessera.operators.indexing.classify`.
    """

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(prepare(batch) if prepare else batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, width: str, by: list[str], lateness: str) -> DataFrame:
    """Counts by time window and columns; rows later than ``lateness`` are left out when run as a stream."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
