"""Completed answers as a stream of files: appended once each, and counted in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assize.functions.scoring import extract_score


def answer_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    """Files of answers that come into a folder; at most ``files`` in a batch, none is left out."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)


def append_once(stream: DataFrame, out: str, checkpoint: str, key: str = "resp_id", time: str = "completed_at", late: str = "14 days"):
    """Writes each answer once (deliveries again within ``late`` of event time are dropped by state); returns the query."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def parse_rates(stream: DataFrame, time: str = "completed_at", window: str = "1 day", late: str = "14 days") -> DataFrame:
    """Per window and model: answers and those with a score. Works on a stream and on a table alike."""
    df = stream.withWatermark(time, late) if stream.isStreaming else stream
    g = df.groupBy(F.window(time, window).alias("w"), "model_id").agg(F.count(F.lit(1)).alias("n"), F.count(extract_score(F.col("response"))).alias("n_scored"))
    return g.select(F.col("w.start").alias("window_start"), "model_id", "n", "n_scored")
