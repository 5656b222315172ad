"""Incremental work: new files as they arrive, and event windows with late data.

Both are built on Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.read import parse_files


def stream_documents(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Parsed documents of files as they appear below ``path``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = files.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return parse_files(found.select("path", "content"))


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now as Parquet and stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by event time; rows later than ``late`` are dropped."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, with state kept only as long as repeats may come."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
