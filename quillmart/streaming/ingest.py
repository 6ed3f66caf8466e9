"""Micro-batch ingestion over Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.functions.durable import ensure_checkpoint_dir


def ingest_events(spark: SparkSession, folder: str, files: str, schema: str, first: str, last: str, lateness: str = "30 days") -> DataFrame:
    """Events in a date range, each event_id once, replays included; reads the files of a folder whose names match.

    The watermark bounds the ids that are remembered; rows outside the range are dropped. State and output are in
    the shared checkpoint folder.
    """
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ingest-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder).where(F.to_date("ts").between(F.lit(first), F.lit(last)))
    # event time needs a zoned timestamp; the session's zone is the one that the naive time is read in
    rows = rows.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness)
    query = rows.dropDuplicatesWithinWatermark(["event_id"]).drop("event_time").writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/rows")


def window_counts(spark: SparkSession, folder: str, files: str, schema: str, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Rows and largest value by event type in tumbling windows, once a window is closed by the watermark.

    Partial counts are what the state holds, one row for each open window and type, so it does not grow with the
    input; later rows of a closed window are dropped.
    """
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/windows-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    rows = rows.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness)
    counted = rows.groupBy(F.window("event_time", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))
    out = counted.select(F.col("window.start").alias("start"), "event_type", "n", "largest")
    query = out.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")
