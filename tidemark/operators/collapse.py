"""Collapsing several observations of one time into one row, whatever the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import labels as L


def mode_of(c: str) -> Column:
    """The most frequent value; a tie goes to the least."""
    return F.coalesce(F.mode(F.col(c), True), F.lit(""))


def label_aggregates(c: str, prefix: str, categories: list[str] = (), scale: dict[str, int] | None = None, hot: str | None = None) -> list[Column]:
    """Mode, set string, number of distinct labels, greatest severity and one 0/1 column per category."""
    out = [mode_of(c).alias(f"{prefix}_mode"), L.set_string(F.col(c)).alias(f"{prefix}_set"), F.count_distinct(F.col(c)).cast("int").alias(f"{prefix}_n")]
    if scale is not None:
        out.append(F.max(L.severity(F.col(c), scale)).alias(f"{prefix}_severity"))
    for category in categories:
        out.append(F.coalesce(F.max((F.col(c) == category).cast("int")), F.lit(0)).alias(f"{hot or prefix}_{L.slug_of(category)}"))
    return out


def most_severe(c: Column, scale: dict[str, int]) -> Column:
    """The most severe of a group's values (an aggregate); a tie goes to the later name."""
    return F.max(F.struct(L.severity(c, scale).alias("s"), c.alias("v")))["v"]


def collapse(df: DataFrame, key: list[str], first: list[str] = (), median: list[str] = (), extra: list[Column] = (), count: str = "n_obs") -> DataFrame:
    """One row a key: columns that don't vary (asserted elsewhere; nulls are passed over), medians, further aggregates, and the number of rows."""
    return df.groupBy(*key).agg(*(F.any_value(F.col(c), F.lit(True)).alias(c) for c in first), *(F.median(c).alias(c) for c in median), F.count("*").alias(count), *extra)


def collapse_weather(raw: DataFrame) -> DataFrame:
    """Raw observations (holiday, temp, rain_1h, snow_1h, clouds_all, weather_main, weather_description, date_time, traffic_volume) to one row an hour."""
    family = L.first_keyword(F.col("weather_description"))
    extra = [
        *label_aggregates("weather_main", "weather_main", list(L.MAIN_SEVERITY), None, "wm"),
        *label_aggregates("weather_description", "weather_desc"),
        most_severe(family, L.FAMILY_SEVERITY).alias("weather_family"),
        F.max(L.severity(F.col("weather_main"), L.MAIN_SEVERITY)).alias("weather_severity"),
    ]
    return collapse(raw, ["date_time"], ["traffic_volume", "holiday", "snow_1h"], ["temp", "rain_1h", "clouds_all"], extra, "n_weather_obs")


def add_extreme_flags(df: DataFrame, categories: tuple[str, ...] = L.EXTREME, prefix: str = "wm") -> DataFrame:
    flags = {f"is_extreme_{L.slug_of(c)}": F.col(f"{prefix}_{L.slug_of(c)}").cast("int") for c in categories}
    return df.withColumns(flags).withColumn("is_extreme_weather", F.greatest(*(F.col(c) for c in flags)))


#: The features of a model of traffic, by how they enter it.
CATEGORICAL = ["hour_dow", "month", "weather_main_mode", "weather_family"]
NUMERIC = ["temp", "rain_1h", "snow_1h", "clouds_all", "weather_severity"]
BINARY = ["is_holiday", *L.main_columns()]


def feature_columns(df: DataFrame) -> DataFrame:
    """The 21 feature columns of a frame, in order; KeyError names those that it lacks."""
    wanted = [*CATEGORICAL, *NUMERIC, *BINARY]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"missing features: {', '.join(missing)}")
    return df.select(*wanted)
