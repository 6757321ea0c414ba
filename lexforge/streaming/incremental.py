"""Incremental jobs as Structured Streaming: sync into a table, near-duplicate gate, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.streaming.merge_table import MergeTable

#: Deltas of a synced table before they go into a new base.
COMPACT = 16


def sync(spark: SparkSession, source: str, schema, target: MergeTable, checkpoint: str, files: int = 8, compact: int = COMPACT) -> None:
    """Merge all new files of ``source`` into a table. A micro-batch writes its own rows; one that is run again is told by its
    number."""

    def merge(batch: DataFrame, number: int) -> None:
        if target.put(batch, number) and target.pending(batch.sparkSession) >= compact:
            target.compact(batch.sparkSession)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of each window and type of an event stream; rows later than ``late`` are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def run_windows(spark: SparkSession, source: str, schema, target: str, checkpoint: str, width: str = "1 hour") -> DataFrame:
    """All closed windows of the files that are there, appended to Parquet."""
    stream = spark.readStream.schema(schema).parquet(source)
    windows(stream, width).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(target)
