"""The aggregates behind exploratory figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def describe(df: DataFrame, column: str, by: list[str] = (), exact: bool = True) -> DataFrame:
    """n, min, max, mean, sample standard deviation, 5th, 50th and 95th percentile (interpolated) and zeros.

    Exact percentiles hold a group's distinct values in a buffer; exact=False takes sketches of bounded size, without interpolation.
    """
    p = lambda q: F.percentile(column, F.lit(q)) if exact else F.percentile_approx(column, q, 100_000)
    return df.groupBy(*by).agg(
        F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("greatest"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"),
        p(0.05).alias("p05"), p(0.5).alias("median"), p(0.95).alias("p95"), F.count_if(F.col(column) == 0).alias("n_zero"),
    )


def pivot_mean(df: DataFrame, row: str, column: str, values: list[int], target: str, prefix: str) -> DataFrame:
    """Mean of the target by row and column, one column a value; the values are given, so no extra pass finds them."""
    out = df.groupBy(row).pivot(column, values).agg(F.avg(target))
    return out.select(row, *(F.col(str(v)).alias(f"{prefix}{v}") for v in values))


def month_year_mean(df: DataFrame, time_col: str, target: str) -> DataFrame:
    """Mean by year with all twelve months: a month without rows is null."""
    years = df.where(F.col(time_col).isNotNull()).select(F.year(time_col).alias("year")).distinct()
    grid = years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    means = df.groupBy(F.year(time_col).alias("year"), F.month(time_col).alias("month")).agg(F.avg(target).alias("mean"), F.count("*").alias("n"))
    return grid.join(means, ["year", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns))


def year_coverage(df: DataFrame, time_col: str, step_seconds: int) -> DataFrame:
    """Rows a year, and distinct steps against those that the year has."""
    t = F.col(time_col)
    year = df.groupBy(F.year(t).alias("year")).agg(F.count("*").alias("n_rows"), F.count_distinct(t).alias("n_present")).where("year is not null")
    days = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date(F.col("year"), F.lit(1), F.lit(1)))
    return year.withColumn("share", (F.col("n_present") / (days * (86400 / step_seconds))))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def yearly_stats(df: DataFrame, time_col: str, target: str) -> DataFrame:
    return df.groupBy(F.year(time_col).alias("year")).agg(F.avg(target).alias("mean"), F.median(target).alias("median"), F.stddev_samp(target).alias("sd"), F.count(target).alias("n"))


def flag_vs_rest(df: DataFrame, by: str, flag: str, target: str) -> DataFrame:
    """Mean of the target by group, with and without a flag."""
    mean = lambda v: F.avg(F.when(F.col(flag) == v, F.col(target)))
    return df.groupBy(by).agg(mean(1).alias("mean_flagged"), mean(0).alias("mean_rest"), F.count_if(F.col(flag) == 1).alias("n_flagged"), F.count_if(F.col(flag) == 0).alias("n_rest"))
