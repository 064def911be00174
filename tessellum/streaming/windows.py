"""Structured Streaming over reports: tumbling and session windows, deduplication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback
from ..sources.bindings import shared_folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with a watermark of an hour."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def hourly(stream: DataFrame) -> DataFrame:
    """STR1: reports an hour and type."""
    out = stream.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return out.select(F.col("window.start").alias("hour"), "event_type", "n", "value")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user; drained in complete mode, those still open at the end of the input are among them."""
    out = stream.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"), "n")


def distinct_events(stream: DataFrame) -> DataFrame:
    """STR9: each event once within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "ts", "event_type")


def limited(stream: DataFrame) -> DataFrame:
    """STR5: which reports on an entry pass the rate limit, with the state of each entry kept between batches."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    reports = stream.select(F.col("event_id").alias("id"), F.col("user_id").alias("agent_id"), k.alias("entry_id"), F.unix_seconds("ts").alias("ts_s"))
    return feedback.rate_limit_stream(reports)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there; its result as a table in the folder of spark.checkpoint.dir."""
    spark = stream.sparkSession
    base = shared_folder(spark)
    run = uuid.uuid4().hex

    def put(batch: DataFrame, no: int) -> None:
        # a batch that is run again replaces its own rows; in complete mode the last batch is the result
        batch.write.mode("overwrite").parquet(f"{base}/stream-{run}/out/batch={0 if mode == 'complete' else no}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/stream-{run}/state").foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/stream-{run}/out").select(*stream.columns)
