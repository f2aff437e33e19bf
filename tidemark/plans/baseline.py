"""How well does an hour x weekday mean, learned before a cut-off, predict the value after it?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import round_doubles
from tidemark.operators.segments import metrics
from tidemark.session import table
from tidemark.sources.shared import stored

CUT = "2024-01-22 00:00:00"


def hourly(events: DataFrame) -> DataFrame:
    """Sum of values per hour; the hour is a TIMESTAMP_NTZ."""
    h = F.date_trunc("HOUR", "ts").cast("timestamp_ntz")
    return events.where("ts is not null").groupBy(h.alias("hour_ts")).agg(F.sum("value").alias("y"))


def fit_group_mean(train: DataFrame, keys: list[str], target: str = "y") -> DataFrame:
    """The mean of the target per key; train is the only data that it sees."""
    return train.groupBy(*keys).agg(F.avg(target).alias("baseline_pred"))


def predict_group_mean(df: DataFrame, means: DataFrame, train: DataFrame, keys: list[str], target: str = "y") -> DataFrame:
    """Left join to the means; an unseen key gets the mean over all of train (one row, so the cross side is bounded)."""
    fallback = train.agg(F.avg(target).alias("_all"))
    return df.join(means, keys, "left").join(F.broadcast(fallback)).withColumn("pred", F.coalesce("baseline_pred", "_all")).drop("_all", "baseline_pred")


def baseline_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hourly(table(spark, sf_dir, "events")).select("hour_ts", "y", F.hour("hour_ts").alias("hour"), F.weekday("hour_ts").alias("day_of_week"))
    df = stored(df, "hours")  # one row an hour; means, fallback and test rows read it, so that events are scanned once
    train, test = df.where(F.col("hour_ts") < F.lit(CUT).cast("timestamp_ntz")), df.where(F.col("hour_ts") >= F.lit(CUT).cast("timestamp_ntz"))
    keys = ["hour", "day_of_week"]
    return round_doubles(metrics(predict_group_mean(test, fit_group_mean(train, keys), train, keys)))


QUERIES = {"baseline_forecast": baseline_forecast}
ORACLE_SQL = {
    "baseline_forecast": f"""
WITH h AS (SELECT date_trunc('hour', ts) AS hour_ts, sum(value) AS y FROM events WHERE ts IS NOT NULL GROUP BY 1),
f AS (SELECT *, hour(hour_ts) AS hour, (dayofweek(hour_ts) + 6) % 7 AS day_of_week FROM h),
tr AS (SELECT * FROM f WHERE hour_ts < TIMESTAMP '{CUT}'),
m AS (SELECT hour, day_of_week, avg(y) AS p FROM tr GROUP BY 1, 2),
s AS (SELECT f.y, coalesce(m.p, (SELECT avg(y) FROM tr)) AS pred FROM f LEFT JOIN m USING (hour, day_of_week) WHERE hour_ts >= TIMESTAMP '{CUT}')
SELECT count(y - pred) AS n, round(avg(abs(y - pred)), 6) AS mae, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
  round(1 - avg((y - pred) * (y - pred)) / nullif(var_pop(y), 0), 6) AS r2 FROM s""",
}
