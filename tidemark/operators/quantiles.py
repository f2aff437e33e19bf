"""Exact quantiles by counting digits: no buffer holds a group's values.

Each interval that a wanted rank lies in is cut into BINS slices by value, a digit to the base BINS; slices are counted, with their least and greatest
value, and the slice of the rank is the next interval. Rows outside the intervals fall out at the scan, so later passes count few. A rank is settled when its
slice has one value. All ranks of all groups and columns go down together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

BINS = 4096
#: Rows up to which exact percentiles are taken from Spark's own buffer of distinct values: at most some 100 MB. The results are the same.
BUFFER_ROWS = 1_000_000


def _digit(x: Column, low: Column, high: Column) -> Column:
    """Which slice of [low, high], finite, a value is in; infinities have slices of their own. It never falls as x rises, whatever is rounded."""
    infinite = F.lit(float("inf"))
    share = (x / 2 - low / 2) / (high / 2 - low / 2)
    inner = F.when(low == high, F.lit(0)).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int"))
    return F.when(x == -infinite, -1).when(x == infinite, BINS).otherwise(inner)


def quantiles(df: DataFrame, columns: list[str], shares: list[float], by: list[str] = ()) -> DataFrame:
    """(by, column_name, share, value): quantiles of each column in each group, interpolated between neighbours as percentile() does. Nulls and NaN are
    passed over; a group without values has no rows. Groups with a null key are groups. Each pass is one scan and one small aggregation; there are about as many as digits to the base BINS tell the values apart.
    """
    keys = [f"_k{i}" for i in range(len(by))] + ["_c"]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns)))
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), each.alias("e")).select(*keys[:-1], F.col("e.c").alias("_c"), F.col("e.x").alias("x")).where("x is not null and not isnan(x)")
    infinite = F.lit(float("inf"))
    finite = F.when(F.abs("x") < infinite, F.col("x"))
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.min(finite), F.lit(0.0)).alias("low"), F.coalesce(F.max(finite), F.lit(0.0)).alias("high"))
    share = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    exact = F.col("share") * (F.col("n") - 1)
    both = F.explode(F.array(F.floor(exact), F.ceil(exact))).alias("rank")
    state = bounds.select("*", share).select("*", both).distinct()
    state = stored(state.select(*keys, "share", "rank", "low", "high", F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("value")), "ranks")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    while True:
        open_ = state.where("value is null")
        if open_.isEmpty():
            break
        slices = open_.groupBy(*keys).agg(F.collect_set(F.struct("low", "high")).alias("slices")).withColumnsRenamed({k: f"s{k}" for k in keys})
        met = rows.join(slices, [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys]).drop(*(f"s{k}" for k in keys))
        inside = F.filter("slices", lambda s: (F.col("x") >= s["low"]) & (F.col("x") <= s["high"]) | (F.abs("x") == F.lit(float("inf"))) & (F.size("slices") == 1))
        met = met.withColumn("s", F.try_element_at(inside, F.lit(1))).where("s is not null")
        counts = met.groupBy(*keys, F.col("s.low").alias("low"), F.col("s.high").alias("high"), _digit(F.col("x"), F.col("s.low"), F.col("s.high")).alias("digit"))
        counts = counts.agg(F.count("*").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
        order = Window.partitionBy(*keys, "low", "high").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("under", F.coalesce(F.sum("c").over(order), F.lit(0))).withColumnsRenamed({k: f"s{k}" for k in keys} | {"low": "_low", "high": "_high"})
        on = [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys] + [F.col("low") == F.col("_low"), F.col("high") == F.col("_high"), F.col("rank") >= F.col("before") + F.col("under"), F.col("rank") < F.col("before") + F.col("under") + F.col("c")]
        found = open_.join(counts, on)
        nxt = found.select(*keys, "share", "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("before") + F.col("under")).alias("before"), F.when(F.col("least") == F.col("most"), F.col("least")).alias("value"))
        state = stored(nxt.unionByName(state.where("value is not null")), "ranks")
    sizes = bounds.select(*keys, "n").withColumnsRenamed({k: f"s{k}" for k in keys})
    values = state.groupBy(*keys, "share").agg(F.min_by("value", "rank").alias("a"), F.max_by("value", "rank").alias("b"))
    values = values.join(sizes, [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys])
    part = F.col("share") * (F.col("n") - 1) - F.floor(F.col("share") * (F.col("n") - 1))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    return values.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), F.col("_c").alias("column_name"), "share", value.alias("value"))


def exact_quantiles(df: DataFrame, column: str, shares: list[float], n: int) -> list[float | None]:
    """Quantiles of one column on the driver, for a frame of n rows: from Spark's buffer while it is small, by digits beyond; equal either way."""
    if n <= BUFFER_ROWS:
        return list(df.agg(F.percentile(F.col(column).cast("double"), F.array(*map(F.lit, shares))).alias("q")).first().q or [None] * len(shares))
    found = {r.share: r.value for r in quantiles(df, [column], shares).collect()}
    return [found.get(float(s)) for s in shares]


def medians(df: DataFrame, columns: list[str], n: int) -> dict[str, float | None]:
    """The median of each column of a frame of n rows."""
    if not columns:
        return {}
    if n <= BUFFER_ROWS:
        return df.agg(*(F.median(F.col(c).cast("double")).alias(c) for c in columns)).first().asDict()
    found = {r.column_name: r.value for r in quantiles(df, columns, [0.5]).collect()}
    return {c: found.get(c) for c in columns}
