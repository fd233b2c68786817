"""Captured events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.runtime import event_stream

SCHEMA = "session_id bigint, ts timestamp, seq bigint, nest_level int, object_type string, object_name string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def count_events(events: DataFrame, path: str, checkpoint: str, watermark: str = "10 minutes") -> StreamingQuery:
    """Events by session and minute, appended as minutes end; those later than the watermark are left out."""
    return event_stream(events, watermark).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
