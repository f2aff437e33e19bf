"""Lags by time and by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag_by_time(df: DataFrame, time_col: str, value: str, hours: list[int], by: list[str] = (), pick=F.max) -> DataFrame:
    """Adds lag_<k>h, the value k hours before: null where that hour has no row, nothing interpolated.

    One shuffle for all lags: each row sends itself to its own time and its value alone to the times k hours later, where pick decides among values of
    repeated times. It partitions by time and group, so a long series needs no single task. Null times have no lags.
    """
    names = [f"lag_{k}h" for k in hours]
    kept = [c for c in df.columns if c not in names]
    row = F.struct(*kept)
    arrivals = [F.struct(F.lit(0).alias("k"), F.col(time_col).alias("at"), row.alias("row"), F.lit(None).cast(df.schema[value].dataType).alias("v"))]
    nobody = F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType)
    arrivals += [F.struct(F.lit(i).alias("k"), (F.col(time_col) + F.expr(f"INTERVAL {k} HOURS")).alias("at"), nobody.alias("row"), F.col(value).alias("v")) for i, k in enumerate(hours, 1)]
    keys = [F.col(c).alias(f"by{i}") for i, c in enumerate(by)]
    sent = df.select(*keys, F.explode(F.array(*arrivals)).alias("a")).select(*(f"by{i}" for i in range(len(keys))), "a.*").where("k = 0 or at is not null")
    here = Window.partitionBy(*(f"by{i}" for i in range(len(keys))), "at")
    out = sent.withColumns({n: F.when(F.col("at").isNotNull(), pick(F.when(F.col("k") == i, F.col("v"))).over(here)) for i, n in enumerate(names, 1)})
    return out.where("k = 0").select("row.*", *names)


def lag_by_range(df: DataFrame, time_col: str, value: str, hours: list[int], by: list[str] = (), bucket_hours: int | None = None) -> DataFrame:
    """The same by range frames over ordered rows.

    A series with a key is partitioned by it. One without is cut into buckets of time, each of which gets the rows of the bucket
    before it as a halo; a bucket is as long as the longest lag (or bucket_hours, if that is more), so the halo holds all that is looked back for, and there are as many tasks as buckets.
    """
    names = [f"lag_{k}h" for k in hours]
    spec = "PARTITION BY {by} ORDER BY {t} RANGE BETWEEN INTERVAL {k} HOURS PRECEDING AND INTERVAL {k} HOURS PRECEDING"
    if by:
        return df.withColumns({n: F.when(F.col(time_col).isNotNull(), F.expr(f"max({value}) OVER ({spec.format(by=', '.join(by), t=time_col, k=k)})")) for n, k in zip(names, hours)})
    kept = [c for c in df.columns if c not in names]
    seconds = 3600 * max([1, *hours, bucket_hours or 0])
    since = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast(df.schema[time_col].dataType), F.col(time_col))
    rows = df.select(F.struct(*kept).alias("row"), F.col(time_col).alias("t"), F.col(value).alias("v"), F.floor(since / seconds).alias("own"))
    halo = rows.select("*", F.explode(F.when(F.col("own").isNull(), F.array(F.col("own"))).otherwise(F.array(F.col("own"), F.col("own") + 1))).alias("bucket"))
    out = halo.withColumns({n: F.expr(f"max(v) OVER ({spec.format(by='bucket', t='t', k=k)})") for n, k in zip(names, hours)})
    return out.where("bucket <=> own").select("row.*", *(F.when(F.col("t").isNotNull(), F.col(n)).alias(n) for n in names))


def lag_by_row(df: DataFrame, time_col: str, value: str, steps: list[int], by: list[str] = ()) -> DataFrame:
    """Adds shift_<k>, the value k rows before: the control that is wrong where hours are missing. Equal times go by value.

    A series without a key is no single task either: rows are numbered within their day, days are counted and summed up
    (one row a day), and the value k rows before is that of the number less by k. Null times come first, as one more day.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(time_col, value)
        return df.withColumns({f"shift_{k}": F.lag(value, k).over(w) for k in steps})
    dated = df.withColumn("_day", F.to_date(time_col))
    counts = dated.groupBy(F.col("_day").alias("_d")).agg(F.count("*").alias("_c"))
    counts = counts.select("_d", (F.sum("_c").over(Window.orderBy("_d")) - F.col("_c")).alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_day").orderBy(time_col, value))
    out = dated.join(counts, F.col("_day").eqNullSafe(F.col("_d"))).withColumn("_nth", number).drop("_day", "_d", "_before")
    series = out.select("_nth", F.col(value).alias("_v"))
    for k in steps:
        past = series.select((F.col("_nth") + k).alias("_nth"), F.col("_v").alias(f"shift_{k}"))
        out = out.join(past, "_nth", "left")
    return out.drop("_nth")
