"""Error metrics over everything and by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 100
NIGHT = (0, 1, 2, 3, 4)
#: The season of each month.
SEASON = {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring", 6: "Summer", 7: "Summer", 8: "Summer", 9: "Fall", 10: "Fall", 11: "Fall"}


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def metrics(df: DataFrame, target: str = "y", pred: str = "pred") -> DataFrame:
    """n, MAE, RMSE and R2 = 1 - SSE / SST in one pass of sums."""
    err = F.col(target) - F.col(pred)
    sums = df.agg(F.count(err).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.var_pop(target).alias("var"))
    return sums.select("n", "mae", F.sqrt("mse").alias("rmse"), (1 - F.col("mse") / F.nullif("var", F.lit(0.0))).alias("r2"))


def report(df: DataFrame, by: list[str], y: str = "y", pred: str = "pred", small: int = SMALL) -> DataFrame:
    """Per segment: n, MAE, RMSE, bias, mean_actual, mean_pred and whether the sample is small."""
    e = F.col(pred) - F.col(y)
    return df.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.avg(y).alias("mean_actual"), F.avg(pred).alias("mean_pred"), (F.count(e) < small).alias("small_sample"),
    )


def with_all_segments(rows: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """A report with a row for every listed segment: n is 0 and the metrics are null where nothing fell into it."""
    return segments.join(rows, by, "left").withColumns({"n": F.coalesce("n", F.lit(0)).cast("long"), "small_sample": F.coalesce("small_sample", F.lit(True))})


def report_by_labels(df: DataFrame, labels: str, y: str = "y", pred: str = "pred", **how) -> DataFrame:
    """By each label of an array column: segments overlap and need not add up."""
    return report(df.select(y, pred, F.explode(F.array_distinct(labels)).alias("label")), ["label"], y, pred, **how)


def report_by_flags(df: DataFrame, flags: list[str], y: str = "y", pred: str = "pred", **how) -> DataFrame:
    """By 0/1 columns, and any and none of them."""
    on = F.filter(F.array(*(F.when(F.col(f) == 1, f) for f in flags)), lambda x: x.isNotNull())
    names = F.when(F.size(on) > 0, F.concat(on, F.array(F.lit("any")))).otherwise(F.array(F.lit("none")))
    return report_by_labels(df.withColumn("_flags", names), "_flags", y, pred, **how)


def compare_by(df: DataFrame, by: str | list[str], y: str, a: str, b: str) -> DataFrame:
    """Two models per group: n, both MAE, mean_actual, both MAE relative to it (null if not positive), and whether a is worse."""
    by = [by] if isinstance(by, str) else by
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(y) - F.col(a))).alias("_a"), F.avg(F.abs(F.col(y) - F.col(b))).alias("_b"), F.avg(y).alias("_m"))
    m = F.when(F.col("_m") > 0, F.col("_m"))
    return sums.select(*by, "n", F.col("_a").alias("mae_a"), F.col("_b").alias("mae_b"), F.col("_m").alias("mean_actual"), (F.col("_a") / m).alias("rel_a"), (F.col("_b") / m).alias("rel_b"), (F.col("_a") > F.col("_b")).alias("a_worse"))


def night_rollup(df: DataFrame, hour: str, y: str, a: str, b: str, night: tuple[int, ...] = NIGHT, by: list[str] = ()) -> DataFrame:
    """compare_by for night and day, in each group of by."""
    return compare_by(df.withColumn("part", F.when(F.col(hour).isin(*night), "night").otherwise("day")), [*by, "part"], y, a, b)


def win_table(df: DataFrame, by: str | list[str], y: str, a: str, b: str) -> DataFrame:
    """Per group the MAE pair, b - a, the better model and whether the sample is small."""
    out = compare_by(df, by, y, a, b)
    by = [by] if isinstance(by, str) else by
    return out.select(*by, "n", "mae_a", "mae_b", (F.col("mae_b") - F.col("mae_a")).alias("delta"), F.when(F.col("mae_a") < F.col("mae_b"), "a").otherwise("b").alias("winner"), (F.col("n") < SMALL).alias("small_sample"))


def window_bias(df: DataFrame, month: str, y: str, pred: str, last_month: int = 9) -> DataFrame:
    """How the MAE of a year's first months differs from the whole year's."""
    e, m = F.abs(F.col(y) - F.col(pred)), F.col(month)
    cut = lambda c: F.avg(F.when(c, e))
    out = df.agg(
        F.count(e).alias("n"), F.avg(e).alias("mae_all"), cut(m <= last_month).alias("mae_first"), cut(m > last_month).alias("mae_rest"),
        F.count_if(m <= last_month).alias("n_first"), F.count_if(m > last_month).alias("n_rest"),
    )
    return out.withColumn("delta", F.col("mae_first") - F.col("mae_all"))


def flag_effect(df: DataFrame, flag: str, time_col: str, y: str, a: str, b: str) -> DataFrame:
    """One row: both models' MAE with and without a 0/1 flag, how many rows and distinct days bear it, and by how much a's MAE grows."""
    mae = lambda p, v: F.avg(F.when(F.col(flag) == v, F.abs(F.col(y) - F.col(p))))
    out = df.agg(
        F.count_if(F.col(flag) == 1).alias("n_flagged"), F.count_if(F.col(flag) == 0).alias("n_rest"), F.count_distinct(F.when(F.col(flag) == 1, F.to_date(time_col))).alias("n_days"),
        mae(a, 1).alias("mae_a_flagged"), mae(a, 0).alias("mae_a_rest"), mae(b, 1).alias("mae_b_flagged"), mae(b, 0).alias("mae_b_rest"),
    )
    return out.withColumn("delta", F.col("mae_a_flagged") - F.col("mae_a_rest"))


def by_day_of_flag(df: DataFrame, flag: str, name: str, time_col: str, y: str, a: str, b: str) -> DataFrame:
    """(day, name, n, mae_a, mae_b) of the flagged days."""
    mae = lambda p: F.avg(F.abs(F.col(y) - F.col(p)))
    return df.where(F.col(flag) == 1).groupBy(F.to_date(time_col).alias("day")).agg(F.array_join(F.sort_array(F.collect_set(name)), ", ").alias("name"), F.count("*").alias("n"), mae(a).alias("mae_a"), mae(b).alias("mae_b"))


def categories_without_rows(df: DataFrame, labels: str, categories: list[str]) -> DataFrame:
    """The listed categories that no row's label array holds: not to be judged, rather than errors of zero."""
    listed = df.sparkSession.createDataFrame([(c,) for c in categories], "label string")
    return listed.join(df.select(F.explode(labels).alias("label")), "label", "left_anti")


def clipped_where(df: DataFrame, pred: str, hour: str, flag: str) -> DataFrame:
    """Of the rows with a negative prediction: their distinct hours in order, and how many bear a 0/1 flag."""
    neg = F.col(pred) < 0
    return df.agg(F.array_join(F.array_sort(F.collect_set(F.when(neg, F.col(hour)))), ",").alias("hours"), F.count_if(neg & (F.col(flag) == 1)).alias("n_flagged"))


def top_segments(df: DataFrame, by: str, y: str, pred: str, n: int = 3) -> DataFrame:
    """The n segments of the greatest MAE, the least key first among equals."""
    return report(df, [by], y, pred).orderBy(F.col("mae").desc(), by).limit(n)


def clip_audit(df: DataFrame, y: str, pred: str) -> DataFrame:
    """What setting negative predictions to zero does: counts, shares, metrics before and after, and whether an error grows anywhere."""
    raw, fixed = F.col(pred), F.greatest(F.lit(0.0), F.col(pred))
    e, g, neg = F.col(y) - raw, F.col(y) - fixed, F.col(pred) < 0
    return df.agg(
        F.count(e).alias("n"), F.count_if(neg).alias("n_negative"), (100.0 * F.count_if(neg) / F.nullif(F.count(e), F.lit(0))).alias("negative_pct"),
        F.min(raw).alias("min_pred"), F.avg(F.when(neg, F.col(y))).alias("mean_actual_negative"),
        F.avg(F.abs(e)).alias("mae_raw"), F.avg(F.abs(g)).alias("mae_clipped"), F.sqrt(F.avg(e * e)).alias("rmse_raw"), F.sqrt(F.avg(g * g)).alias("rmse_clipped"),
        F.bool_and(F.abs(g) <= F.abs(e) + 1e-9).alias("never_worse"), F.count_if(F.abs(g) != F.abs(e)).alias("n_changed"),
    )


def seed_summary(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Mean, population standard deviation, least and greatest over seeds."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(value).alias("n"))


def season_of(month: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in SEASON.items() for x in kv)), month)
