"""Gap clusters over a stream: session windows with a watermark. An addition: no operator to match works on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events (ts, user_id), batch or stream -> user_id, start, end, n of each session."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions_of(spark: SparkSession, path: str) -> DataFrame:
    """The sessions of all events in the files that are there.

    In batch, as a stream in append mode gives out a session only when the watermark has passed its end, and so never
    the last ones.
    """
    return sessions(spark.read.parquet(path))
