"""Clicks on results as a stream: counts per article and window, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLICK = "article_id string, query string, position int, ts timestamp"


def read_clicks(spark: SparkSession, path: str, schema: str = CLICK) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def click_counts(clicks: DataFrame, *, by: str = "article_id", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same plan for a stream and for a table; the watermark only matters to a stream."""
    held = clicks.withWatermark("ts", late) if clicks.isStreaming else clicks
    return held.groupBy(F.window("ts", window).alias("w"), F.col(by)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def append_articles(stream: DataFrame, write, checkpoint: str):
    """Runs ``write(batch, epoch)`` on each batch of an article stream; the writer makes its own appends idempotent."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
