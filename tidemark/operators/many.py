"""Many ridge models from one pass, and expanding windows from sums that add up.

A frame in long form has a row once for each model that it trains; its medians and sums are aggregated by model. For expanding
windows rows are summed once by block of time; the sums before a cut are those of the blocks before it, so no window reads rows again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import splits
from tidemark.operators.ridge import Ridge, Sums, sums_by


def memberships(df: DataFrame, column: str, of: list[tuple[Column, Column]]) -> DataFrame:
    """Long form: each row once for each (name, condition) that holds, the name in a new column; rows without any are gone."""
    named = F.filter(F.array(*(F.when(when, name) for name, when in of)), lambda x: x.isNotNull())
    return df.withColumn(column, F.explode(named))


def _medians(rows: DataFrame, y: str, by: str, numeric: list[str]) -> dict[object, tuple[dict[str, float], float]]:
    """Medians and the target's mean of each group."""
    found = rows.where(F.col(y).isNotNull()).groupBy(by).agg(F.avg(y).alias("_y"), *(F.median(F.col(c).cast("double")).alias(f"m_{c}") for c in numeric)).collect()
    return {r[by]: ({c: r[f"m_{c}"] if r[f"m_{c}"] is not None else 0.0 for c in numeric}, r["_y"]) for r in found}


def _origin(medians: dict[object, tuple[dict[str, float], float]], numeric: list[str]) -> list[float]:
    mean = lambda values: sum(values) / max(1, len(values))
    return [mean([m[c] for m, _ in medians.values()]) for c in numeric] + [mean([y for _, y in medians.values()])]


def fit_many(rows: DataFrame, y: str, by: str, numeric: list[str], categorical: list[str] = (), binary: list[str] = (), alpha: float = 1.0) -> tuple[dict[object, Ridge], dict[object, int]]:
    """The model of each value of `by`, and its number of training rows. rows in long form are read for medians and for sums, whatever the number of models, which must be few."""
    medians = _medians(rows, y, by, list(numeric))
    sums = sums_by(rows, y, [by], numeric, categorical, binary, _origin(medians, list(numeric)))
    return {k: s.moments(medians[k][0]).solve(alpha) for (k,), s in sums.items()}, {k: s.n for (k,), s in sums.items()}


def predicted(rows: DataFrame, by: str, models: dict[object, Ridge], name: str = "pred") -> DataFrame:
    """rows with the prediction of the model that `by` names; null for others."""
    out = F.lit(None).cast("double")
    for k, model in models.items():
        out = F.when(F.col(by) == F.lit(k), model.expression()).otherwise(out)
    return rows.withColumn(name, out)


def metrics_by(rows: DataFrame, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """segments.metrics of each group, in one pass."""
    e = F.col(y) - F.col(pred)
    sums = rows.groupBy(*by).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("var"))
    return sums.select(*by, "n", "mae", F.sqrt("mse").alias("rmse"), (1 - F.col("mse") / F.nullif("var", F.lit(0.0))).alias("r2"))


def passed(time_col: str, cuts: list[str]) -> Column:
    """How many of the cuts, in order, a time is not before: the block of time that it lies in."""
    return reduce(lambda a, b: a + b, ((F.col(time_col) >= splits.ntz(c)).cast("int") for c in cuts), F.lit(0))


def block_sums(df: DataFrame, time_col: str, cuts: list[str], y: str, numeric: list[str], categorical: list[str] = (), binary: list[str] = (), unit: str = "MONTH", origin: list[float] | None = None) -> dict[tuple, Sums]:
    """Sums by block: (cuts passed, start of the month or other unit). Blocks never lie across a cut, and their number is that of months, not of rows."""
    blocks = df.where(F.col(time_col).isNotNull()).withColumns({"_passed": passed(time_col, sorted(cuts)), "_unit": F.date_trunc(unit, time_col).cast("string")})
    return sums_by(blocks, y, ["_passed", "_unit"], numeric, categorical, binary, origin)


def fit_expanding(df: DataFrame, time_col: str, cuts: list[str], y: str, numeric: list[str], categorical: list[str] = (), binary: list[str] = (), alpha: float = 1.0, unit: str = "MONTH") -> dict[str, Ridge]:
    """For each cut the model of the rows before it: medians of all windows from one aggregation, sums of all windows as prefix sums over blocks."""
    order = sorted(set(cuts))
    windows = memberships(df, "_cut", [(F.lit(c), F.col(time_col) < splits.ntz(c)) for c in order])
    medians = _medians(windows, y, "_cut", list(numeric))
    blocks = block_sums(df, time_col, order, y, numeric, categorical, binary, unit, _origin(medians, list(numeric)))
    out: dict[str, Ridge] = {}
    running: Sums | None = None
    for i, c in enumerate(order):
        for key in sorted(k for k in blocks if k[0] == i):  # those after the cut before and before this one
            running = blocks[key] if running is None else running + blocks[key]
        if running is None:
            raise ValueError(f"no training rows before {c}")
        out[c] = running.moments(medians[c][0]).solve(alpha)
    return out


def means_expanding(df: DataFrame, time_col: str, cuts: list[str], y: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(_cut, keys, base) and (_cut, _all), the means of the rows before each cut by key and over all: rows are summed once by block and key, blocks then by the cuts after them."""
    order = sorted(set(cuts))
    rows = df.where(F.col(time_col) < splits.ntz(order[-1])).withColumn("_passed", passed(time_col, order))
    sums = rows.groupBy("_passed", *keys).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    windows = memberships(sums, "_cut", [(F.lit(c), F.col("_passed") <= i) for i, c in enumerate(order)])
    mean = (F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("base")
    by_key = windows.groupBy("_cut", *keys).agg(mean)
    return by_key, windows.groupBy("_cut").agg(mean.alias("_all"))


def score_windows(df: DataFrame, time_col: str, cuts: list[str], until: list[str], models: dict[str, Ridge], y: str, keys: list[str]) -> DataFrame:
    """Test rows of every window (from its cut to its end) with fold, pred and base: the model's and the group mean's prediction, both of the rows before the cut.
    Windows may overlap; a row comes once for each. A key that no row before the cut has gets the mean of all of these."""
    windows = [(F.struct(F.lit(i).alias("fold"), F.lit(a).alias("_cut")), (F.col(time_col) >= splits.ntz(a)) & (F.col(time_col) < splits.ntz(b))) for i, (a, b) in enumerate(zip(cuts, until, strict=True))]
    rows = memberships(df, "_w", windows).select("*", "_w.fold", "_w._cut").drop("_w")
    means, whole = means_expanding(df, time_col, cuts, y, keys)
    rows = predicted(rows, "_cut", models).join(means, ["_cut", *keys], "left").join(whole, "_cut", "left")
    return rows.withColumn("base", F.coalesce("base", "_all")).drop("_cut", "_all")
