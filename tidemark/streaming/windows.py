"""Streaming counterparts: the collapse of observations by window, sessions, and duplicates within the watermark.

The batch functions and these share their aggregates, so closed windows equal batch results. Event times are TIMESTAMP:
a watermark refuses TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.collapse import label_aggregates


def with_event_time(stream: DataFrame, time_col: str, delay: str) -> DataFrame:
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)


def collapse_windows(df: DataFrame, time_col: str, width: str, label: str, value: str, slide: str | None = None) -> DataFrame:
    """One row a window: rows, median and sum of the value, mode and set of the label. Batch or stream."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    out = df.groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.sum(value).alias("total"), *label_aggregates(label, "label")[:2])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "median", "total", "label_mode", "label_set")


def sessions(df: DataFrame, time_col: str, gap: str, by: str, value: str) -> DataFrame:
    """One row a session: times of one key that are less than the gap apart."""
    out = df.groupBy(F.session_window(time_col, gap).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def first_of_key(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that there is and stops; files and their log make it exactly once."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
