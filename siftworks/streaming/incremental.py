"""Incremental jobs: landed files, deduplication across batches, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.normalize import triple_key


def import_landed(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """All JSON files that landed since the last run are appended to ``target``; the checkpoint is the place to go on from."""
    landed = spark.readStream.schema(schema).json(folder)
    return landed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(statements: DataFrame, delay: str = "24 hours") -> DataFrame:
    """A stream of ``subject, predicate, object, at`` without the statements seen before, for as long as the watermark keeps them."""
    keyed = statements.withColumn("triple_hash", triple_key(F.col("subject"), F.col("predicate"), F.col("object")))
    return keyed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["triple_hash"])


def counts_by_window(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by type and window; late rows count until the watermark passes. An extension, not part of the entity database."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
