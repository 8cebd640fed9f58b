"""Incremental ingest: whatever is new is cleaned and written by partition, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_new(spark: SparkSession, source: str, schema: str, clean: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, partition: str) -> StreamingQuery:
    """Reads files that arrived since the last run and appends them, partitioned. A batch that is
    repeated after a failure replaces its own folder, so rows are written once."""

    def sink(batch: DataFrame, number: int) -> None:
        clean(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", partition).parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, at: str, key: str, late: str = "2 days") -> DataFrame:
    """Counts by key and day of a stream; rows later than ``late`` behind the newest are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day"), key).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), key, "n")
