"""Raw and clean observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.labels import main_columns
from tidemark.operators.quality import coerce, schema_check

#: The columns of a raw observation.
RAW_COLUMNS = ["holiday", "temp", "rain_1h", "snow_1h", "clouds_all", "weather_main", "weather_description", "date_time", "traffic_volume"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV (gzip too) with all columns as text in one pass: only the empty field is null, 'None' is a value. A missing path raises."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).csv(path)


def load_raw(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """Typed rows, and which columns are missing or extra. Without date_time it raises."""
    text = scan_text(spark, path)
    if "date_time" not in text.columns:
        raise KeyError("date_time")
    typed = coerce(text, timestamps=["date_time"], doubles=["temp", "rain_1h", "snow_1h", "clouds_all"], longs=["traffic_volume"], strings=["holiday", "weather_main", "weather_description"])
    return typed, schema_check(text, RAW_COLUMNS)


def write_clean(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Parquet, in folders of `by` if given, so that later scans skip what their filters exclude."""
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


def load_clean(spark: SparkSession, path: str, format: str = "parquet", check: bool = True) -> DataFrame:
    """What write_clean (or, with format csv, write_csv) wrote, typed anew: numbers that cannot be read are null, a label column that has none is 0.

    It collapses nothing and sorts nothing: who needs an order sorts the result. check counts rows by time first and raises if one repeats; readers that need no proof leave it out.
    """
    df = scan_text(spark, path) if format == "csv" else spark.read.parquet(path)
    df = coerce(df, timestamps=["date_time"] if format == "csv" else [], doubles=["temp", "rain_1h", "snow_1h", "clouds_all"], longs=["traffic_volume", "weather_severity"])
    hot = [c for c in main_columns() if c in df.columns]
    df = df.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in hot}) if hot else df
    return assert_one_row_a_time(df) if check else df


def assert_one_row_a_time(df: DataFrame, time_col: str = "date_time") -> DataFrame:
    """df itself; raises if a time has several rows."""
    if not df.groupBy(time_col).count().where("count > 1").limit(1).isEmpty():
        raise ValueError("the clean table has several rows of one time")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file a task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A table of group means: (hour, day_of_week, baseline_pred)."""
    return spark.read.schema("hour int, day_of_week int, baseline_pred double").option("header", True).csv(path)
