"""Data quality: coercion, invalid measurements, duplicate groups, invariants, coverage, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import NO_HOLIDAY


def schema_check(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    """Columns that are missing or extra, by name."""
    return {"missing": sorted(set(expected) - set(df.columns)), "extra": sorted(set(df.columns) - set(expected))}


def coerce(df: DataFrame, timestamps: list[str] = (), doubles: list[str] = (), longs: list[str] = (), strings: list[str] = ()) -> DataFrame:
    """Text columns to types: what cannot be read becomes null, a missing string the empty string."""
    out = {c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz") for c in timestamps}
    out |= {c: F.col(c).try_cast("double") for c in doubles}
    out |= {c: F.col(c).try_cast("double").try_cast("long") for c in longs}
    out |= {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strings}
    return df.withColumns({k: v for k, v in out.items() if k in df.columns})


def drop_bad_times(df: DataFrame, time_col: str) -> tuple[DataFrame, Column]:
    """The rows with a time, and the aggregate that counts those without."""
    if time_col not in df.columns:
        raise KeyError(time_col)
    return df.where(F.col(time_col).isNotNull()), F.count_if(F.col(time_col).isNull())


def above(c: str, least: float = 0.0) -> Column:
    """The value, or null where it is not physically possible (at most `least`)."""
    return F.when(F.col(c) > least, F.col(c))


def without_sentinels(c: str, values: list[float]) -> Column:
    """The value, or null where it equals a sentinel exactly; large true values stay."""
    return F.when(~F.col(c).isin(*values), F.col(c))


def flag_invalid(df: DataFrame, above_zero: list[str] = (), sentinels: dict[str, list[float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """The cleaned rows, and one row of counts: invalid values per column and nulls after cleaning."""
    rules = {c: above(c) for c in above_zero} | {c: without_sentinels(c, v) for c, v in (sentinels or {}).items()}
    clean = df.withColumns(rules)
    stats = df.agg(
        F.count("*").alias("n_rows"),
        *(F.count_if(F.col(c).isNotNull() & rule.isNull()).alias(f"invalid_{c}") for c, rule in rules.items()),
        *(F.count_if(rule.isNull()).alias(f"null_{c}") for c, rule in rules.items()),
    )
    return clean, stats


def varies(c: str) -> Column:
    """Whether a column has several values in a group, null being one (an aggregate)."""
    return F.coalesce(F.min(c) < F.max(c), F.lit(False)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))


def duplicate_audit(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row: groups, groups with several rows and the rows in them, their sizes, and per column the groups in which it varies (null being a value). A column varies if
    its least and greatest value differ or if only some are null, which partial aggregation finds without a copy of the rows for each column."""
    groups = df.groupBy(*key).agg(F.count("*").alias("_n"), *(varies(c).alias(f"_d_{c}") for c in columns))
    several = F.col("_n") > 1
    return groups.agg(
        F.sum("_n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(several).alias("n_duplicate_groups"),
        F.coalesce(F.sum(F.when(several, F.col("_n"))), F.lit(0)).alias("rows_in_duplicates"),
        F.min(F.when(several, F.col("_n"))).alias("min_size"), F.max(F.when(several, F.col("_n"))).alias("max_size"),
        *(F.count_if(several & F.col(f"_d_{c}")).alias(f"varies_{c}") for c in columns),
    )


def invariant_violations(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, column, n_values) of groups in which a column that must not vary does. Groups that break the rule are found by least and greatest values; only their rows are counted by value."""
    broken = df.groupBy(*key).agg(*(varies(c).alias(f"_v{i}") for i, c in enumerate(columns)))
    broken = broken.where(" or ".join(f"_v{i}" for i in range(len(columns)))).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    rows = df.join(broken, same, "left_semi").select(*key, F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns))).alias("c")).select(*key, "c.*")
    values = rows.groupBy(*key, "column_name", "v").agg(F.lit(1).alias("_one"))
    return values.groupBy(*key, "column_name").agg(F.count("*").alias("n_values")).where("n_values > 1")


def assert_invariants(df: DataFrame, key: list[str], columns: list[str]) -> None:
    """Raises, naming the columns, if one varies inside a group."""
    bad = [r.column_name for r in invariant_violations(df, key, columns).select("column_name").distinct().collect()]
    if bad:
        raise ValueError(f"columns that vary within a group: {', '.join(sorted(bad))}")


def holiday_audit(df: DataFrame, time_col: str, holiday_col: str) -> DataFrame:
    """(holiday, n_rows, n_days) per named value; 'None' and the empty string name no holiday."""
    named = df.where(~F.coalesce(F.col(holiday_col), F.lit("")).isin("", NO_HOLIDAY))
    return named.groupBy(F.col(holiday_col).alias("holiday")).agg(F.count("*").alias("n_rows"), F.count_distinct(F.to_date(time_col)).alias("n_days"))


STEPS = {"HOUR": "INTERVAL 1 HOUR", "DAY": "INTERVAL 1 DAY"}


def missing_steps(df: DataFrame, time_col: str, step: str = "HOUR", by: list[str] = ()) -> DataFrame:
    """(by, missing): steps of the grid from the first to the last time, per group, that have no row. Nothing is filled in."""
    t = F.date_trunc(step, F.col(time_col)).cast("timestamp_ntz")
    present = df.where(F.col(time_col).isNotNull()).select(*by, t.alias("missing")).distinct()
    bounds = present.groupBy(*by).agg(F.min("missing").alias("_a"), F.max("missing").alias("_b"))
    grid = bounds.where("_a is not null").select(*by, F.explode(F.sequence("_a", "_b", F.expr(STEPS[step]))).alias("missing"))
    return grid.join(present, [*by, "missing"], "left_anti")


def missing_runs(df: DataFrame, time_col: str, step: str = "HOUR", by: list[str] = (), bucket_steps: int = 4096) -> DataFrame:
    """(by, from, to, steps): the runs of steps without rows between the first and the last time of each group, found as gaps between neighbours: the grid is never made.

    Present steps are numbered and cut into buckets of time; neighbours inside a bucket are found by a window over it, and each bucket passes its first and
    last step on, one row a bucket, to find the gaps between buckets. So a long series is many tasks, and a year without rows is one row.
    """
    seconds = {"HOUR": 3600, "DAY": 86400}[step]
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    number = F.floor(F.timestamp_diff("SECOND", start, F.date_trunc(step, F.col(time_col)).cast("timestamp_ntz")) / seconds)
    keys = [f"_k{i}" for i in range(len(by))]
    present = df.where(F.col(time_col).isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys)), number.alias("_n")).distinct()
    present = present.withColumn("_bucket", F.floor(F.col("_n") / bucket_steps))
    inside = present.select(*keys, F.lag("_n").over(Window.partitionBy(*keys, "_bucket").orderBy("_n")).alias("_a"), F.col("_n").alias("_b"))
    ends = present.groupBy(*keys, "_bucket").agg(F.min("_n").alias("_first"), F.max("_n").alias("_last"))
    between = ends.select(*keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_a"), F.col("_first").alias("_b"))
    gaps = inside.unionByName(between).where("_b - _a > 1")
    at = lambda n: F.timestamp_add("SECOND", n * seconds, start).cast("timestamp_ntz")
    return gaps.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), at(F.col("_a") + 1).alias("from"), at(F.col("_b") - 1).alias("to"), (F.col("_b") - F.col("_a") - 1).alias("steps"))


def coverage(df: DataFrame, time_col: str, step: str = "HOUR", by: list[str] = ()) -> DataFrame:
    """(by, first, last, expected, present, missing, missing_ratio) of the grid's steps."""
    t = F.date_trunc(step, F.col(time_col)).cast("timestamp_ntz")
    present = df.where(F.col(time_col).isNotNull()).select(*by, t.alias("_t")).distinct()
    seconds = {"HOUR": 3600, "DAY": 86400}[step]
    span = (F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))) / seconds
    out = present.groupBy(*by).agg(F.min("_t").alias("first"), F.max("_t").alias("last"), F.count("*").alias("present"))
    out = out.withColumn("expected", (span + 1).cast("long")).withColumn("missing", F.col("expected") - F.col("present"))
    return out.withColumn("missing_ratio", (F.col("missing") / F.col("expected")))


def first_missing(df: DataFrame, time_col: str, step: str = "HOUR", n: int = 10) -> DataFrame:
    """One row: the first n missing steps in order, and how many these are. A report, so the limit is the feature."""
    return missing_steps(df, time_col, step).orderBy("missing").limit(n).agg(F.array_join(F.array_sort(F.collect_list(F.date_format("missing", "yyyy-MM-dd HH:mm"))), ",").alias("first"), F.count("*").alias("n_shown"))


def reconcile(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """One row that compares two lists of (key, name): matched, named otherwise, only left, only right. The four counts don't overlap."""
    a, b = left.select(key, F.col(name).alias("_a")), right.select(key, F.col(name).alias("_b"))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("_a") == F.col("_b")).alias("n_matched"), F.count_if(F.col("_a") != F.col("_b")).alias("n_named_otherwise"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("n_only_left"), F.count_if(F.col("_b").isNotNull() & F.col("_a").isNull()).alias("n_only_right"),
    )
