"""Experiments, models, sources and artifacts as queries, each beside its SQL.

The series is orders by day: y is the mean price, x the number of orders with some days taken out (so that medians fill it).
With one feature, or the levels of one category, ridge has a closed form, so SQL can state every model that is fitted here.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar as C
from tidemark.functions import labels as L
from tidemark.functions import numbers as N
from tidemark.operators import collapse, many, quality, ridge, segments, splits
from tidemark.plans import experiments as X
from tidemark.plans import policy as P
from tidemark.plans import scoring, training, versions
from tidemark.plans.baseline import CUT, fit_group_mean, hourly
from tidemark.plans.catalogue import DAYS, HOURS, days, events, hours, orders, query
from tidemark.plans.solved import one_hot, solved
from tidemark.session import table
from tidemark.sources import artifacts as A
from tidemark.sources import digests, partitioned, raw
from tidemark.sources.shared import new_path, stored
from tidemark.streaming import corrections

ALPHA = 10.0
FINAL = "2002-01-01 00:00:00"
OLDER, LAST_YEAR = "1998-01-01 00:00:00", "2000-01-01 00:00:00"
FOLDS, ENDS = ["1998-01-01 00:00:00", "1999-01-01 00:00:00", "2000-01-01 00:00:00"], ["1999-01-01 00:00:00", "2000-01-01 00:00:00", "2001-01-01 00:00:00"]
DAILY = X.Setup("day", "y", ["day"], FINAL, ["x"], baseline=["month", "day_of_week"], alpha=ALPHA)
HOURLY = X.Setup("hour_ts", "y", ["hour_ts"], "2030-01-01 00:00:00", ["x"], alpha=ALPHA)
BARE = X.Setup("hour_ts", "y", ["hour_ts"], "2030-01-01 00:00:00", [], alpha=ALPHA)

SERIES = f"{DAYS}, e AS (SELECT day, y, day_of_week, month, year, CASE WHEN n_orders % 7 <> 3 THEN n_orders END::DOUBLE AS x FROM days)"
SERIES_H = f"{HOURS}, e AS (SELECT hour_ts, y, hour, day_of_week, month, year, CASE WHEN hour % 5 <> 2 THEN hour END::DOUBLE AS x FROM hours)"
METRICS = "count(pred - y) AS n, avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) * (y - pred))) AS rmse, 1 - avg((y - pred) * (y - pred)) / nullif(var_pop(y), 0) AS r2"
ROUNDED = "n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = days(spark, sf_dir).withColumn("x", F.when(F.col("n_orders") % 7 != 3, F.col("n_orders")).cast("double"))
    return stored(df.select("day", "y", "x", "day_of_week", "month", "year"), "daily")


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hours(spark, sf_dir).withColumn("x", F.when(F.col("hour") % 5 != 2, F.col("hour")).cast("double"))
    return stored(df.select("hour_ts", "y", "x", "hour", "day_of_week", "month", "year"), "hourly")


def fitted(name: str, train: str, test: str, alpha: float = ALPHA, y: str = "y", x: str = "x") -> str:
    """CTEs that end in `name`: the rows of test with pred, by ridge on one feature, filled with train's median and scaled. train and test are table expressions."""
    filled = f"coalesce({x}, m)"
    return (
        f"{name}_t AS (SELECT * FROM {train}), {name}_m AS (SELECT quantile_cont({x}, 0.5) AS m FROM {name}_t), "
        f"{name}_f AS (SELECT any_value(m) AS m, count(*) AS k, avg({filled}) AS mx, var_pop({filled}) AS v, covar_pop({filled}, {y}) AS c, avg({y}) AS my FROM {name}_t, {name}_m), "
        f"{name} AS (SELECT t.*, my + k * c / (k + {alpha}) * (coalesce(t.{x}, f.m) - mx) / v AS pred FROM {test} t, {name}_f f)"
    )


def before(cut: str, time: str = "day", rel: str = "e") -> str:
    return f"(SELECT * FROM {rel} WHERE {time} < TIMESTAMP '{cut}')"


def since(cut: str, until: str | None = None, time: str = "day", rel: str = "e") -> str:
    return f"(SELECT * FROM {rel} WHERE {time} >= TIMESTAMP '{cut}'" + (f" AND {time} < TIMESTAMP '{until}')" if until else ")")


def ranked(seed: int, rel: str = "e", key: str = "day") -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || {key}), {key}) AS rk, count(*) OVER () AS total FROM {rel})"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- models ---------------------------------------------------------------------------------------------------------


@query("ridge_fit_predict", f"WITH {SERIES}, {fitted('s', before(LAST_YEAR), since(LAST_YEAR))} SELECT day, round(y, 6) AS y, round(pred, 6) AS pred FROM s")
def ridge_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = daily(spark, sf_dir)
    return DAILY.fit(DAILY.before(df, LAST_YEAR)).predict(DAILY.since(df, LAST_YEAR)).select("day", "y", "pred")


@query("ols_fit_predict", f"WITH {SERIES}, {fitted('s', before(LAST_YEAR), since(LAST_YEAR), 0)} SELECT day, round(pred, 6) AS pred FROM s")
def ols_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = daily(spark, sf_dir)
    return DAILY.fit(DAILY.before(df, LAST_YEAR), 0.0).predict(DAILY.since(df, LAST_YEAR)).select("day", "pred")


@query(
    "ridge_one_hot",
    f"""WITH {SERIES}, g AS (SELECT day_of_week AS d, count(*) AS k, avg(y) AS ym FROM e WHERE day < TIMESTAMP '{LAST_YEAR}' GROUP BY 1),
b AS (SELECT sum(k * {ALPHA} / (k + {ALPHA}) * ym) / sum(k * {ALPHA} / (k + {ALPHA})) AS b FROM g)
SELECT d AS day_of_week, round(b + k * (ym - b) / (k + {ALPHA}), 6) AS pred FROM g, b""",
)
def ridge_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction for each level of a category, all levels having a weight of their own."""
    df = daily(spark, sf_dir)
    model = ridge.fit(DAILY.before(df, LAST_YEAR), "y", [], ["day_of_week"], alpha=ALPHA)
    return model.predict(DAILY.before(df, LAST_YEAR).select("day_of_week").distinct())


@query(
    "design_matrix",
    f"""WITH {SERIES}, t AS (SELECT * FROM {before(LAST_YEAR)}), m AS (SELECT quantile_cont(x, 0.5) AS m FROM t), f AS (SELECT any_value(m) AS m, avg(coalesce(x, m)) AS mx, stddev_pop(coalesce(x, m)) AS sd FROM t, m)
SELECT day, round((coalesce(x, m) - mx) / sd, 6) AS n_x, (month = 12)::DOUBLE AS b_december, """
    + ", ".join(f"(day_of_week = {d})::INT AS h_day_of_week_{d}" for d in range(7))
    + " FROM e, f",
)
def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians, scales and levels of the training rows, applied to all rows as columns."""
    df = daily(spark, sf_dir).withColumn("december", F.when(F.col("month") == 12, 1))
    model = ridge.fit(DAILY.before(df, LAST_YEAR), "y", ["x"], ["day_of_week"], ["december"])
    return model.one_hot(df).select("day", "n_x", "b_december", *(f"h_day_of_week_{d}" for d in range(7)))


@query(
    "model_save_load",
    f"WITH {SERIES}, {fitted('s', before(LAST_YEAR), since(LAST_YEAR))}, q AS (SELECT {METRICS} FROM s) SELECT {ROUNDED} FROM q",
)
def model_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained, written as JSON, read again, evaluated."""
    df = daily(spark, sf_dir)
    with tempfile.TemporaryDirectory() as at:  # a file of the driver alone
        A.save_model(f"{at}/model.json", DAILY.fit(DAILY.before(df, LAST_YEAR)))
        model = A.load_model(f"{at}/model.json")
    return segments.metrics(model.predict(DAILY.since(df, LAST_YEAR)))


# --- experiments ----------------------------------------------------------------------------------------------------


def _random_sql() -> str:
    parts = [f"WITH {SERIES}, {fitted('tm', before(LAST_YEAR), '(SELECT * FROM e)')}, t AS (SELECT avg(abs(y - pred)) AS mae FROM tm WHERE day >= TIMESTAMP '{LAST_YEAR}')"]
    rows = []
    for s in X.SEEDS:
        parts.append(f"r{s} AS (SELECT * FROM {ranked(s)})")
        parts.append(fitted(f"p{s}", f"(SELECT * FROM r{s} WHERE rk <= floor(total * 0.7::DOUBLE))", f"(SELECT * FROM r{s} WHERE rk > floor(total * 0.7::DOUBLE) + floor(total * 0.15::DOUBLE))"))
        rows.append(f"SELECT {s}::BIGINT AS seed, (SELECT avg(abs(y - pred)) FROM p{s}) AS own, (SELECT avg(abs(tm.y - tm.pred)) FROM tm JOIN p{s} USING (day)) AS same")
    parts.append("u AS (" + " UNION ALL ".join(rows) + ")")
    return ", ".join(parts) + " SELECT seed, round(own, 6) AS mae_random, round(same, 6) AS mae_time_same_rows, round(own - t.mae, 6) AS own_rows, round(own - same, 6) AS same_rows FROM u, t"


@query("experiment_random_vs_time", _random_sql())
def experiment_random_vs_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.random_vs_time(DAILY, daily(spark, sf_dir), LAST_YEAR)
    rows = [(r["seed"], r["random"]["mae"], r["time_on_same_rows"]["mae"], r["own_rows"], r["same_rows"]) for r in found["per_seed"]]
    return frame(spark, rows, "seed long, mae_random double, mae_time_same_rows double, own_rows double, same_rows double")


def _arms_sql() -> str:
    parts, rows = [f"WITH {SERIES}, past AS (SELECT * FROM {before(LAST_YEAR)}), lasty AS (SELECT * FROM {since(LAST_YEAR)})"], []
    for s in X.SEEDS:
        parts.append(f"h{s} AS (SELECT * FROM {ranked(s, 'lasty')})")
        parts.append(f"t{s} AS (SELECT * FROM h{s} WHERE rk > floor(total * 0.5::DOUBLE))")
        parts.append(f"c{s} AS (SELECT * FROM past UNION ALL SELECT day, y, day_of_week, month, year, x FROM h{s} WHERE rk <= floor(total * 0.5::DOUBLE))")
        parts.append(f"d{s} AS (SELECT * FROM c{s} ORDER BY md5('{s}|' || day), day LIMIT (SELECT count(*) FROM past))")
        for arm, train in (("a", before(OLDER)), ("b", "past"), ("c", f"c{s}"), ("d", f"d{s}")):
            parts.append(fitted(f"{arm}{s}p", train, f"t{s}"))
            rows.append(f"SELECT '{arm.upper()}' AS arm, (SELECT avg(abs(y - pred)) FROM {arm}{s}p) AS v")
    parts.append("u AS (" + " UNION ALL ".join(rows) + ")")
    return ", ".join(parts) + " SELECT arm, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS greatest, count(*) AS n FROM u GROUP BY 1"


@query("experiment_training_arms", _arms_sql())
def experiment_training_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.training_arms(DAILY, daily(spark, sf_dir), OLDER, LAST_YEAR)
    return frame(spark, [(k, *(found[k][c] for c in ("mean", "sd", "least", "greatest", "n"))) for k in "ABCD"], "arm string, mean double, sd double, least double, greatest double, n long")


_ODD = "(SELECT * FROM e WHERE day >= TIMESTAMP '2000-01-01' AND month % 2 = 1)"


@query(
    "experiment_alternate_months",
    f"""WITH {SERIES}, {fitted("a", before(LAST_YEAR), _ODD)}, {fitted("b", f"(SELECT * FROM e WHERE day < TIMESTAMP '{LAST_YEAR}' OR month % 2 = 0)", _ODD)},
q AS (SELECT 'P1' AS arm, {METRICS} FROM a UNION ALL SELECT 'P2', {METRICS} FROM b) SELECT arm, {ROUNDED} FROM q""",
)
def experiment_alternate_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.alternate_months(DAILY, daily(spark, sf_dir), LAST_YEAR)
    return frame(spark, [(k, *(m[c] for c in ("n", "mae", "rmse", "r2"))) for k, m in found.items()], "arm string, n long, mae double, rmse double, r2 double")


_FOLDS_SQL = ", ".join(fitted(f"f{i}", before(a), since(a, b)) for i, (a, b) in enumerate(zip(FOLDS, ENDS, strict=True)))
_FOLDS_M = "q AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS fold, {METRICS} FROM f{i}" for i in range(3)) + ")"


@query(
    "experiment_rolling_origin",
    f"""WITH {SERIES}, {_FOLDS_SQL}, {_FOLDS_M}, c AS (SELECT (SELECT mae FROM q WHERE fold = 2) / (SELECT mae FROM q WHERE fold = 0) - 1 AS d)
SELECT fold, {ROUNDED}, CASE WHEN d > 0.1 THEN 'worse' WHEN d < -0.1 THEN 'better' ELSE 'flat' END AS trend FROM q, c""",
)
def experiment_rolling_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.rolling_origin(DAILY, daily(spark, sf_dir), FOLDS, ENDS)
    return frame(spark, [(i, *(m[c] for c in ("n", "mae", "rmse", "r2")), found["trend"]) for i, m in enumerate(found["folds"])], "fold long, n long, mae double, rmse double, r2 double, trend string")


_POOLED = "p AS (" + " UNION ALL ".join(f"SELECT month, y, pred FROM f{i}" for i in range(3)) + ")"


@query("experiment_rolling_months", f"WITH {SERIES}, {_FOLDS_SQL}, {_POOLED} SELECT month, count(*) AS n, round(avg(abs(pred - y)), 6) AS mae, round(avg(pred - y), 6) AS bias FROM p GROUP BY 1")
def experiment_rolling_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.rolling_origin(DAILY, daily(spark, sf_dir), FOLDS, ENDS)
    return frame(spark, [(r["month"], r["n"], r["mae"], r["bias"]) for r in found["by_month"]], "month int, n long, mae double, bias double")


@query(
    "experiment_drift",
    f"""WITH {SERIES}, q AS (SELECT list_distinct(quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM e WHERE year = 1996),
b AS (SELECT year, len(list_filter((SELECT q FROM q), lambda z: z <= y)) AS bin, count(*) AS k FROM e GROUP BY ALL), t AS (SELECT year, sum(k) AS total FROM b GROUP BY 1),
g AS (SELECT year, total, unnest(range(0, len((SELECT q FROM q)) + 1)) AS bin FROM t), s AS (SELECT g.year, g.bin, greatest(coalesce(k, 0) / total, 1e-6) AS share FROM g LEFT JOIN b ON b.year = g.year AND b.bin = g.bin),
r AS (SELECT s.year, sum((s.share - o.share) * ln(s.share / o.share)) AS psi FROM s JOIN s o ON o.year = 1996 AND o.bin = s.bin WHERE s.year <> 1996 GROUP BY 1)
SELECT e.year, round(avg(y), 6) AS mean, round(any_value(psi), 6) AS psi FROM e LEFT JOIN r ON r.year = e.year GROUP BY 1""",
)
def experiment_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.covariate_drift(DAILY, daily(spark, sf_dir), ["y"], 1996)
    return frame(spark, [(r["year"], r["mean"], found["psi"]["y"].get(r["year"])) for r in found["target"]], "year int, mean double, psi double")


WEEKS = ["2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00"], ["2024-01-15 00:00:00", "2024-01-22 00:00:00", "2024-02-01 00:00:00"]


def _night_sql() -> str:
    parts, rows = [f"WITH {SERIES_H}"], []
    for i, (a, b) in enumerate(zip(*WEEKS, strict=True)):
        train, test = before(a, "hour_ts"), since(a, b, "hour_ts")
        parts.append(fitted(f"w{i}", train, test))
        parts.append(f"b{i} AS (SELECT hour, day_of_week, avg(y) AS bp FROM {train} GROUP BY ALL), s{i} AS (SELECT w.*, coalesce(bp, (SELECT avg(y) FROM {train})) AS base FROM w{i} w LEFT JOIN b{i} USING (hour, day_of_week))")
        rows.append(f"SELECT {i}::BIGINT AS fold, CASE WHEN hour <= 4 THEN 'night' ELSE 'day' END AS part, y, pred, base FROM s{i}")
    parts.append("u AS (" + " UNION ALL ".join(rows) + ")")
    return ", ".join(parts) + " SELECT fold, part, count(*) AS n, round(avg(abs(y - pred)), 6) AS mae_a, round(avg(abs(y - base)), 6) AS mae_b, avg(abs(y - pred)) > avg(abs(y - base)) AS a_worse FROM u GROUP BY ALL"


@query("experiment_night_hours", _night_sql())
def experiment_night_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.night_hours(HOURLY, hourly_series(spark, sf_dir), *WEEKS)
    rows = [(i, part, *(r[c] for c in ("n", "mae_a", "mae_b", "a_worse"))) for i, f in enumerate(found) for part, r in f["parts"].items()]
    return frame(spark, rows, "fold long, part string, n long, mae_a double, mae_b double, a_worse boolean")


@query(
    "experiment_log_target",
    f"""WITH {SERIES}, l AS (SELECT *, ln(1 + y) AS ly FROM e), {fitted("a", before(LAST_YEAR), since(LAST_YEAR))}, {fitted("g", before(LAST_YEAR, rel="l"), since(LAST_YEAR, rel="l"), y="ly")},
b AS (SELECT y, exp(pred) - 1 AS pred FROM g), q AS (SELECT 'linear' AS target, {METRICS} FROM a UNION ALL SELECT 'log', {METRICS} FROM b) SELECT target, {ROUNDED} FROM q""",
)
def experiment_log_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.log_target(DAILY, daily(spark, sf_dir), LAST_YEAR)
    return frame(spark, [(k, *(m[c] for c in ("n", "mae", "rmse", "r2"))) for k, m in found.items()], "target string, n long, mae double, rmse double, r2 double")


_GRID = ", ".join(repr(a) for a in ridge.WIDE_ALPHAS)


@query(
    "experiment_alpha_sensitivity",
    f"""WITH {SERIES}, t AS (SELECT * FROM {before(LAST_YEAR)}), m AS (SELECT quantile_cont(x, 0.5) AS m FROM t),
f AS (SELECT any_value(m) AS m, count(*) AS k, avg(coalesce(x, m)) AS mx, var_pop(coalesce(x, m)) AS v, covar_pop(coalesce(x, m), y) AS c, avg(y) AS my FROM t, m), a AS (SELECT unnest([{_GRID}])::DOUBLE AS alpha),
r AS (SELECT alpha, avg(abs(y - (my + k * c / (k + alpha) * (coalesce(x, m) - mx) / v))) AS mae FROM {since(LAST_YEAR)} e, f, a GROUP BY 1), b AS (SELECT mae AS best FROM r ORDER BY round(mae, 2), alpha LIMIT 1)
SELECT alpha, round(mae, 6) AS mae, mae <= best + 0.5 AS as_good FROM r, b""",
)
def experiment_alpha_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = daily(spark, sf_dir)
    found = X.alpha_sensitivity(DAILY, DAILY.before(df, LAST_YEAR), DAILY.since(df, LAST_YEAR))
    return frame(spark, [(a, m, a in found["as_good"]) for a, m, _ in found["rows"]], "alpha double, mae double, as_good boolean")


@query(
    "experiment_window_bias",
    f"""WITH {SERIES}, {fitted("s", before("1999-01-01 00:00:00"), since("1999-01-01 00:00:00", LAST_YEAR))}, w AS (SELECT month, avg(abs(y - pred)) AS mae FROM s GROUP BY 1 ORDER BY mae DESC, month LIMIT 3)
SELECT count(*) AS n, round(avg(abs(y - pred)), 6) AS mae_all, round(avg(abs(y - pred)) FILTER (month <= 9), 6) AS mae_first, round(avg(abs(y - pred)) FILTER (month <= 9) - avg(abs(y - pred)), 6) AS delta,
  (SELECT string_agg(month::VARCHAR, ',' ORDER BY mae DESC, month) FROM w) AS worst FROM s""",
)
def experiment_window_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = daily(spark, sf_dir)
    r = X.test_window_bias(DAILY, DAILY.before(df, "1999-01-01 00:00:00"), DAILY.before(DAILY.since(df, "1999-01-01 00:00:00"), LAST_YEAR))
    return frame(spark, [(r["n"], r["mae_all"], r["mae_first"], r["delta"], ",".join(map(str, r["worst"])))], "n long, mae_all double, mae_first double, delta double, worst string")


_LAGGED = ", ".join(f"l{k}.y AS f{i}" for i, k in enumerate(X.LAG_HOURS)), " ".join(f"JOIN o l{k} ON o.hour_ts = l{k}.hour_ts + INTERVAL {k} HOUR" for k in X.LAG_HOURS)
_SHIFTED = ", ".join(f"lag(y, {k}) OVER (ORDER BY hour_ts) AS f{i}" for i, k in enumerate(X.LAG_HOURS))
_SEEDS = "[" + ", ".join(f"{s}::BIGINT" for s in X.SEEDS) + "]"


def _lag_sql() -> str:
    train = f"(SELECT arm || seed AS model, y, f0, f1, f2 FROM dealt WHERE rk <= floor(total * 0.7::DOUBLE) UNION ALL SELECT arm || 'time', y, f0, f1, f2 FROM dealt WHERE seed = {X.SEEDS[0]} AND hour_ts < TIMESTAMP '{CUT}')"
    test = f"(SELECT arm || seed AS model, arm, seed, y, f0, f1, f2 FROM dealt WHERE rk > floor(total * 0.7::DOUBLE) + floor(total * 0.15::DOUBLE) UNION ALL SELECT arm || 'time', arm, NULL, y, f0, f1, f2 FROM dealt WHERE seed = {X.SEEDS[0]} AND hour_ts >= TIMESTAMP '{CUT}')"
    return f"""WITH RECURSIVE {HOURS}, o AS (SELECT hour_ts, y FROM hours), arms AS (
SELECT 'none' AS arm, hour_ts, y, 0::DOUBLE AS f0, 0::DOUBLE AS f1, 0::DOUBLE AS f2 FROM o
UNION ALL SELECT 'time', o.hour_ts, o.y, {_LAGGED[0]} FROM o {_LAGGED[1]}
UNION ALL SELECT * FROM (SELECT 'row', hour_ts, y, {_SHIFTED} FROM o) WHERE f2 IS NOT NULL),
seeds AS (SELECT unnest({_SEEDS}) AS seed), dealt AS (SELECT *, row_number() OVER (PARTITION BY arm, seed ORDER BY md5(seed || '|' || hour_ts), hour_ts) AS rk, count(*) OVER (PARTITION BY arm, seed) AS total FROM arms, seeds),
{solved("s", train, test, ["f0", "f1", "f2"], [], ALPHA)}, e AS (SELECT arm, seed, avg(abs(y - pred)) AS mae FROM s GROUP BY ALL), t AS (SELECT arm, mae FROM e WHERE seed IS NULL)
SELECT e.arm AS lags, round(any_value(t.mae), 6) AS mae_time, round(avg(e.mae - t.mae), 6) AS optimism, round(stddev_pop(e.mae - t.mae), 6) AS sd, count(*) AS n FROM e JOIN t USING (arm) WHERE seed IS NOT NULL GROUP BY e.arm"""


@query("experiment_lag_leak", _lag_sql())
def experiment_lag_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags of 1, 24 and 168 hours, five seeds."""
    found = X.lag_leak(BARE, hourly_series(spark, sf_dir), CUT)
    return frame(spark, [(k, v["time"]["mae"], *(v["optimism"][c] for c in ("mean", "sd", "n"))) for k, v in found.items()], "lags string, mae_time double, optimism double, sd double, n long")


#: Development windows of the audit, the first of them the pseudo-test, and the final window.
AUDIT_CUTS, AUDIT_ENDS = ["2024-01-15 00:00:00", "2024-01-08 00:00:00", "2024-01-11 00:00:00", "2024-01-18 00:00:00"], ["2024-01-22 00:00:00", "2024-01-11 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00"]
END = "2024-02-01 00:00:00"


def _audit_sql() -> str:
    windows = [(-1, CUT, END, X.DRAW_SEED), *((i, a, b, X.DRAW_SEED + 1 if i == 0 else X.DRAW_SEED + 9 + i) for i, (a, b) in enumerate(zip(AUDIT_CUTS, AUDIT_ENDS, strict=True)))]
    parts, scored = [f"WITH {SERIES_H}"], []
    for i, a, b, _ in windows:
        w = f"w{i + 1}"
        parts.append(fitted(w, before(a, "hour_ts"), since(a, b, "hour_ts")))
        parts.append(f"{w}_b AS (SELECT hour, day_of_week, avg(y) AS bp FROM {before(a, 'hour_ts')} GROUP BY ALL)")
        scored.append(f"SELECT {i}::BIGINT AS fold, hour_ts, hour, month, y, pred, coalesce(bp, (SELECT avg(y) FROM {before(a, 'hour_ts')})) AS base FROM {w} LEFT JOIN {w}_b USING (hour, day_of_week)")
    parts.append("s AS (" + " UNION ALL ".join(scored) + ")")
    parts.append(f"z(fold, seed) AS (VALUES {', '.join(f'({i}, {seed})' for i, _, _, seed in windows)})")
    parts.append("d AS (SELECT fold, hour_ts::DATE AS block, count(*) AS k, sum(abs(y - pred)) AS a, sum(abs(y - base)) AS c FROM s GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY block) - 1 AS nth, count(*) OVER (PARTITION BY fold) AS blocks FROM d)")
    parts.append(f"p AS (SELECT fold, draw, ('0x' || substr(md5(seed || '-' || draw || '-' || pick), 1, 8))::BIGINT % blocks AS nth FROM (SELECT DISTINCT fold, blocks FROM o) JOIN z USING (fold), (SELECT unnest(range(0, {X.DRAWS})) AS draw) q, LATERAL (SELECT unnest(range(0, blocks)) AS pick) l)")
    parts.append("r AS (SELECT fold, draw, (sum(c) - sum(a)) / sum(k) AS dm FROM p JOIN o USING (fold, nth) GROUP BY ALL), i AS (SELECT fold, quantile_cont(dm, 0.025) AS lo, quantile_cont(dm, 0.975) AS hi, 100.0 * avg((dm > 0)::INT::DOUBLE) AS better FROM r GROUP BY fold)")
    parts.append("t AS (SELECT fold, (sum(c) - sum(a)) / sum(k) AS point FROM d GROUP BY fold), m AS (SELECT fold, month, avg(abs(y - pred)) < avg(abs(y - base)) AS won FROM s GROUP BY ALL), n AS (SELECT fold, count(*) FILTER (won) AS won, count(*) AS months FROM m GROUP BY fold)")
    parts.append("v AS (SELECT CASE WHEN better > 50 AND (lo > 0 OR hi < 0) THEN 'better' WHEN better > 50 THEN 'probably_better' ELSE 'not_better' END AS verdict FROM i WHERE fold = -1), y AS (SELECT count(*) FILTER (point > 0) AS windows_better, bool_and(better > 50) AS all_agree FROM i JOIN t USING (fold) WHERE fold >= 0)")
    return ", ".join(parts) + """ SELECT fold, round(point, 6) AS point, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(better, 6) AS better_pct, won AS months_won, months,
(SELECT round(avg(abs(y - pred)) FILTER (hour <= 4), 6) FROM s WHERE s.fold = i.fold) AS night_mae_a, (SELECT round(avg(abs(y - base)) FILTER (hour <= 4), 6) FROM s WHERE s.fold = i.fold) AS night_mae_b, verdict, windows_better, all_agree
FROM i JOIN t USING (fold) JOIN n USING (fold), v, y"""


@query("experiment_final_audit", _audit_sql())
def experiment_final_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final window (fold -1) scored by the stored model and the stored baseline table, once a policy is frozen; four development windows fitted
    before their own cuts; 4,000 draws each, and one verdict over all."""
    df = hourly_series(spark, sf_dir)
    train = HOURLY.before(df, CUT)
    with tempfile.TemporaryDirectory() as at:  # files of the driver alone
        registry = scoring.Registry(at)
        decided = P.decide(train.withColumn("pred", F.col("y")), train.withColumn("pred", F.col("y")), "y", "pred")
        registry.save(HOURLY.fit(train), fit_group_mean(train, ["hour", "day_of_week"]), P.sign(decided, "now"), {"rows": train.count()})
        registry.policy()  # refuses without a frozen policy
        model, baseline = registry.model(), registry.baseline(spark)
    window = HOURLY.before(HOURLY.since(df, CUT), END)
    overall = train.agg(F.avg("y")).first()[0]
    scored = model.predict(window).join(baseline, ["hour", "day_of_week"], "left").withColumn("base", F.coalesce("baseline_pred", F.lit(overall)))
    final, development, v = X.audit(HOURLY, train, AUDIT_CUTS, AUDIT_ENDS, scored)
    rows = [
        (i, w["d_mae"]["point"], w["d_mae"]["ci_low"], w["d_mae"]["ci_high"], w["d_mae"]["better_pct"], w["months_won"], len(w["months"]), *(w["night"].get("night", {}).get(c) for c in ("mae_a", "mae_b")), v["final"], v["windows_better"], v["all_windows_agree"])
        for i, w in [(-1, final), *enumerate(development)]
    ]
    return frame(spark, rows, "fold long, point double, ci_low double, ci_high double, better_pct double, months_won long, months long, night_mae_a double, night_mae_b double, verdict string, windows_better long, all_agree boolean")


# --- sources, sinks, artifacts --------------------------------------------------------------------------------------

RAW = {
    "holiday": "CASE WHEN event_id % 50 = 0 THEN 'Labor Day' ELSE 'None' END", "temp": "CASE WHEN event_id % 9 = 0 THEN '' ELSE (250 + event_id % 60) || '.5' END", "rain_1h": "CASE WHEN event_id % 13 = 0 THEN 'wet' ELSE '0.25' END", "snow_1h": "'0.0'",
    "clouds_all": "(event_id % 101) || ''", "weather_main": "CASE event_id % 3 WHEN 0 THEN 'Clear' WHEN 1 THEN 'Rain' ELSE 'Snow' END", "weather_description": "CASE event_id % 3 WHEN 0 THEN 'sky is clear' WHEN 1 THEN 'light rain' ELSE 'light snow' END",
}
_STAMP = "CASE WHEN event_id % 97 = 0 THEN 'never' ELSE {t} END"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw observations in a CSV, with fields that cannot be read."""
    e = events(spark, sf_dir).where("ts is not null")
    stamp = F.when(F.col("event_id") % 97 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select(*(F.expr(v).alias(k) for k, v in RAW.items()), stamp.alias("date_time"), F.col("event_id").cast("string").alias("traffic_volume"))


_TYPED = f"""x AS (SELECT {", ".join(f"{v} AS {k}" for k, v in RAW.items())}, {_STAMP.format(t="strftime(ts, '%Y-%m-%d %H:%M:%S')")} AS date_time, event_id AS traffic_volume FROM events WHERE ts IS NOT NULL),
typed AS (SELECT holiday, TRY_CAST(temp AS DOUBLE) AS temp, TRY_CAST(rain_1h AS DOUBLE) AS rain_1h, TRY_CAST(snow_1h AS DOUBLE) AS snow_1h, TRY_CAST(clouds_all AS DOUBLE) AS clouds_all, weather_main, weather_description, TRY_CAST(date_time AS TIMESTAMP) AS date_time, traffic_volume FROM x)"""


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "raw.csv")
    raw.write_csv(raw_events(spark, sf_dir), path)
    return raw.load_raw(spark, path)[0]


@query("raw_csv_scan", f"WITH {_TYPED} SELECT * FROM typed", digits=None)
def raw_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV, scanned as text, coerced."""
    return loaded(spark, sf_dir).select(*raw.RAW_COLUMNS)


@query("drop_bad_times", f"WITH {_TYPED} SELECT count(*) FILTER (date_time IS NOT NULL) AS n_kept, count(*) FILTER (date_time IS NULL) AS n_dropped FROM typed")
def drop_bad_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = loaded(spark, sf_dir)
    kept, dropped = quality.drop_bad_times(df, "date_time")
    return df.agg(dropped.alias("n_dropped")).join(F.broadcast(kept.agg(F.count("*").alias("n_kept"))))


_HOT = ", ".join(f"max((weather_main = '{k}')::INT) AS wm_{k.lower()}" for k in L.MAIN_SEVERITY)
_CLEAN = f"""{_TYPED}, c AS (SELECT date_time, count(*) AS n_weather_obs, quantile_cont(temp, 0.5) AS temp, quantile_cont(rain_1h, 0.5) AS rain_1h, quantile_cont(clouds_all, 0.5) AS clouds_all, {_HOT},
  max(CASE weather_main WHEN 'Clear' THEN 0 ELSE 3 END) AS weather_severity FROM typed WHERE date_time IS NOT NULL GROUP BY 1)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collapsed observations, written and loaded again."""
    path = new_path(spark, "clean")
    raw.write_clean(collapse.collapse_weather(quality.drop_bad_times(loaded(spark, sf_dir), "date_time")[0]), path)
    return raw.load_clean(spark, path, check=False)


@query("clean_round_trip", f"WITH {_CLEAN} SELECT date_time, n_weather_obs, temp, rain_1h, clouds_all, weather_severity::BIGINT AS weather_severity, wm_clear, wm_rain, wm_snow, wm_squall FROM c")
def clean_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV, coercion, collapse, Parquet, and the clean reload."""
    return cleaned(spark, sf_dir).select("date_time", "n_weather_obs", "temp", "rain_1h", "clouds_all", "weather_severity", "wm_clear", "wm_rain", "wm_snow", "wm_squall")


@query(
    "feature_contract",
    f"""WITH {_CLEAN} SELECT date_time, hour(date_time) || '_' || (isodow(date_time) - 1) AS hour_dow, month(date_time)::INT AS month, temp, wm_rain, ({C.holiday_sql("date_time")} <> 'None')::INT AS is_holiday, 21 AS n_features,
  greatest(wm_snow, wm_thunderstorm, wm_squall) AS is_extreme_weather FROM c""",
)
def feature_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of a model, and that they are the 21 of the contract."""
    df = collapse.add_extreme_flags(C.add_calendar_features(C.add_holiday_flag(cleaned(spark, sf_dir), "date_time"), "date_time"))
    n = len(collapse.feature_columns(df).columns)
    return df.select("date_time", "hour_dow", "month", "temp", "wm_rain", "is_holiday", F.lit(n).alias("n_features"), "is_extreme_weather")


_COUNTED = ", ".join(f"count(*) FILTER (weather_main = '{k}') AS n_{k.lower()}" for k in ("Clear", "Rain", "Snow"))
_CONTRACT = f"""{_CLEAN}, l AS (SELECT date_time, any_value(snow_1h) AS snow_1h, {_COUNTED} FROM typed WHERE date_time IS NOT NULL GROUP BY 1),
z AS (SELECT date_trunc('hour', ts) AS hour_ts, sum(value) AS y FROM events WHERE ts IS NOT NULL GROUP BY 1),
k AS (SELECT c.*, snow_1h, y, CASE WHEN n_clear >= n_rain AND n_clear >= n_snow THEN 'Clear' WHEN n_rain >= n_snow THEN 'Rain' ELSE 'Snow' END AS weather_main_mode, CASE WHEN n_snow > 0 THEN 'snow' WHEN n_rain > 0 THEN 'rain' ELSE 'clear' END AS weather_family,
  hour(date_time) || '_' || (isodow(date_time) - 1) AS hour_dow, month(date_time)::INT AS month, ({C.holiday_sql("date_time")} <> 'None')::INT AS is_holiday FROM c JOIN l USING (date_time) JOIN z ON z.hour_ts = date_trunc('hour', date_time))"""
_CONTRACT_LEVELS = [
    *one_hot("hour_dow", [f"{h}_{d}" for h in range(24) for d in range(7)]), *one_hot("month", list(range(1, 13))), *one_hot("weather_main_mode", ["Clear", "Rain", "Snow"]), *one_hot("weather_family", ["clear", "rain", "snow"]),
    *(f"{c} = 1" for c in collapse.BINARY),
]


def _contract_sql() -> str:
    of = lambda times: "(" + " UNION ALL ".join(f"SELECT {i} AS model, * FROM k WHERE {when}" for i, when in enumerate(times)) + ")"
    train = of([f"date_time < TIMESTAMP '{a}'" for a in WEEKS[0]])
    test = of([f"date_time >= TIMESTAMP '{a}' AND date_time < TIMESTAMP '{b}'" for a, b in zip(*WEEKS, strict=True)])
    return f"""WITH RECURSIVE {_CONTRACT}, {solved("s", train, test, collapse.NUMERIC, _CONTRACT_LEVELS, ALPHA)}, q AS (SELECT model, {METRICS} FROM s GROUP BY model)
SELECT model::BIGINT AS fold, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) AS r2 FROM q"""


@query("contract_ridge", _contract_sql(), digits=4)
def contract_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of an hour by a model of all 21 features (numbers, categories and flags) of its observations, on three expanding windows, whose sums are taken once a month and cut."""
    df = collapse.add_extreme_flags(C.add_calendar_features(C.add_holiday_flag(cleaned(spark, sf_dir), "date_time"), "date_time"))
    hour = F.date_trunc("HOUR", "date_time").cast("timestamp_ntz").alias("hour_ts")
    df = df.select("date_time", hour, *collapse.feature_columns(df).columns).join(hourly(events(spark, sf_dir)), "hour_ts")
    df = stored(df, "contract")
    models = many.fit_expanding(df, "date_time", WEEKS[0], "y", collapse.NUMERIC, collapse.CATEGORICAL, collapse.BINARY, ALPHA)
    windows = [(F.struct(F.lit(i).cast("long").alias("fold"), F.lit(a).alias("cut")), (F.col("date_time") >= splits.ntz(a)) & (F.col("date_time") < splits.ntz(b))) for i, (a, b) in enumerate(zip(*WEEKS, strict=True))]
    rows = many.memberships(df, "w", windows).select("*", "w.fold", "w.cut")
    return many.metrics_by(many.predicted(rows, "cut", models), ["fold"])


@query("schema_check", "SELECT * FROM (VALUES ('extra', 'note'), ('missing', 'clouds_all'), ('missing', 'holiday')) t(kind, column_name)")
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "odd.csv")
    raw.write_csv(raw_events(spark, sf_dir).drop("holiday", "clouds_all").withColumn("note", F.lit("x")), path)
    found = raw.load_raw(spark, path)[1]
    return frame(spark, [(k, c) for k, cs in found.items() for c in cs], "kind string, column_name string")


_MONTHS = "SELECT o_orderkey, o_custkey + {add} AS o_custkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderdate IS NOT NULL"
_FIELD = "coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_NUMBER = "('0x' || substr(md5(" + " || '|' || ".join(_FIELD.format(c=c) for c in ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")) + "), 1, 15))::BIGINT::HUGEINT"
REWRITTEN = "1997-03"


@query(
    "partition_rewrite",
    f"""WITH a AS ({_MONTHS.format(add=0)}), b AS ({_MONTHS.format(add=f"(strftime(o_orderdate, '%Y-%m') = '{REWRITTEN}')::INT")}), x AS (SELECT month, count(*) AS n, sum({_NUMBER}) AS s FROM a GROUP BY 1), y AS (SELECT month, sum({_NUMBER}) AS s FROM b GROUP BY 1)
SELECT month, n AS n_rows, x.s::VARCHAR AS signature, 1::BIGINT AS n_files, 0::BIGINT AS n_same, (x.s <> y.s)::INT::BIGINT AS n_changed FROM x JOIN y USING (month)""",
)
def partition_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month, written, written again, and written with one month changed: the files of each month, and how many the second and the third write made new."""
    path = new_path(spark, "months")
    df = orders(spark, sf_dir).where("o_orderdate is not null").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    changed = df.withColumn("o_custkey", F.col("o_custkey") + (F.col("month") == REWRITTEN).cast("int"))
    states = []
    for version in (df, df, changed):
        partitioned.write_changed(version, path, ["month"])
        states.append(stored(partitioned.files_by(spark, path, ["month"]), "files"))
    new = lambda a, b: a.join(b, ["month", "file"], "left_anti").groupBy("month").agg(F.count("*").alias("n"))
    out = states[0].groupBy("month").agg(F.count("*").alias("n_files")).join(partitioned.signatures(df, ["month"]), "month")
    out = out.join(new(states[1], states[0]).withColumnRenamed("n", "n_same"), "month", "left").join(new(states[2], states[1]).withColumnRenamed("n", "n_changed"), "month", "left")
    return out.select("month", F.col("rows").alias("n_rows"), F.col("signature").cast("string").alias("signature"), "n_files", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_same", "n_changed")))


@query("baseline_table_scan", f"WITH {HOURS} SELECT hour, day_of_week, round(avg(y), 6) AS baseline_pred FROM hours WHERE hour_ts < TIMESTAMP '{CUT}' GROUP BY ALL")
def baseline_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group means written as CSV and scanned again."""
    path = new_path(spark, "baseline.csv")
    train = hours(spark, sf_dir).where(F.col("hour_ts") < F.lit(CUT).cast("timestamp_ntz"))
    raw.write_csv(fit_group_mean(train, ["hour", "day_of_week"]), path)
    return raw.load_baseline(spark, path)


@query("json_artifact", "SELECT n_name AS name, n_regionkey AS region FROM nation")
def json_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as at:  # a file of the driver alone
        A.write_json(f"{at}/nations.json", {r.n_name: r.n_regionkey for r in table(spark, sf_dir, "nation").collect()})
        found = A.read_json(f"{at}/nations.json")
    return frame(spark, list(found.items()), "name string, region int")


@query("json_rows", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","nothing":null}' AS json FROM nation""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.json_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("nothing")))


@query("markdown_report", "SELECT '# Nations' || chr(10) || chr(10) || '## By region' || chr(10) || chr(10) || '| region | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_regionkey || ' | ' || n || ' |', chr(10) ORDER BY n_regionkey) || chr(10) || chr(10) || '## Note' || chr(10) || chr(10) || 'All of them.' || chr(10) AS report FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n")).orderBy("region")
    return frame(spark, [(A.report("Nations", [("By region", counts), ("Note", "All of them.")]),)], "report string")


@query("checksum_verify", "SELECT sha256(string_agg(r_name, ',' ORDER BY r_regionkey)) AS sha256, true AS verified, true AS other_refused FROM region")
def checksum_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "names")
    names = ",".join(r.r_name for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect())
    frame(spark, [(names,)], "value string").coalesce(1).write.option("lineSep", "\u0000").text(path)  # one file; its last byte is the separator
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.sha2(F.expr("substring(content, 1, octet_length(content) - 1)"), 256).alias("s")).first().s
    whole = A.sha256_of(spark, f"{path}/part-*").first().sha256
    A.verify_sha256(spark, f"{path}/part-*", whole)
    try:
        A.verify_sha256(spark, f"{path}/part-*", found)
        refused = False
    except ValueError:
        refused = True
    return frame(spark, [(found, True, refused)], "sha256 string, verified boolean, other_refused boolean")


#: Bytes of a range and digests of a node of the two queries below.
RANGE, NODE = 2048, 8
_LINE = "o_orderkey || '|' || o_custkey || '|' || {status} || '|' || o_orderpriority || chr(10)"


def _ranges_sql(name: str, status: str) -> str:
    """CTEs that end in `name`: (month, bytes, n_ranges, part, sha256) of a file for each month of orders, a line for each order."""
    return (
        f"{name}_f AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, string_agg({_LINE.format(status=status)}, '' ORDER BY o_orderkey) AS body FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1), "
        f"{name}_n AS (SELECT month, body, length(body)::BIGINT AS bytes, (length(body) + {RANGE - 1}) // {RANGE} AS n_ranges FROM {name}_f), "
        f"{name} AS (SELECT month, bytes, n_ranges, i AS part, sha256(substr(body, i * {RANGE} + 1, {RANGE})) AS sha256 FROM (SELECT *, unnest(range(n_ranges)) AS i FROM {name}_n))"
    )


def order_files(spark: SparkSession, sf_dir: str, name: str, status: Column) -> str:
    """A folder with a text file for each month of orders, a line for each order."""
    o = table(spark, sf_dir, "orders").where("o_orderdate is not null")
    lines = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.concat_ws("|", "o_orderkey", "o_custkey", status, "o_orderpriority").alias("line"))
    path = new_path(spark, name)
    lines.repartition("month").sortWithinPartitions("month", "o_orderkey").select("month", "line").write.partitionBy("month").text(path)
    return path


def _of_month(df: DataFrame) -> DataFrame:
    """Files are named by tasks; their folders name the month."""
    return df.withColumn("name", F.regexp_extract("name", "month=([^/]+)/", 1))


_UP = ", ".join(f"l{i} AS (SELECT month, bytes, n_ranges, ceil(w / {NODE})::BIGINT AS w, part // {NODE} AS part, CASE WHEN w = 1 THEN min(sha256) ELSE sha256(string_agg(sha256, '' ORDER BY part)) END AS sha256 FROM l{i - 1} GROUP BY month, bytes, n_ranges, w, part // {NODE})" for i in range(1, 6))


@query(
    "file_digest_tree",
    f"""WITH {_ranges_sql("r", "o_orderstatus")}, l0 AS (SELECT *, n_ranges AS w FROM r), {_UP}
SELECT month, l5.bytes, l5.n_ranges, l5.sha256 AS root, sha256(body) AS whole FROM l5 JOIN r_n USING (month)""",
)
def file_digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every file: the root of the tree over its ranges' digests, and beside it the digest of all its bytes."""
    path = order_files(spark, sf_dir, "orders-by-month", F.col("o_orderstatus"))
    tree = digests.roots(digests.record(spark, path, new_path(spark, "ranges"), RANGE), NODE)
    whole = digests.streamed_sha256(spark, path).select("name", F.col("sha256").alias("whole"))
    return _of_month(tree.join(whole, "name")).select(F.col("name").alias("month"), "bytes", "n_ranges", "root", "whole")


@query(
    "altered_file_ranges",
    f"""WITH {_ranges_sql("a", "o_orderstatus")}, {_ranges_sql("b", "CASE WHEN o_totalprice > 400000 THEN 'held' ELSE o_orderstatus END")}
SELECT month, part, part * {RANGE} AS start, CASE WHEN a.sha256 IS NULL THEN 'added' WHEN b.sha256 IS NULL THEN 'removed' ELSE 'altered' END AS status
FROM a FULL JOIN b USING (month, part) WHERE a.sha256 IS DISTINCT FROM b.sha256""",
)
def altered_file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written again after some orders got another status: the ranges that tell, where bytes moved all those behind."""
    status = F.when(F.col("o_totalprice") > 400000, "held").otherwise(F.col("o_orderstatus"))
    sides = [_of_month(digests.record(spark, order_files(spark, sf_dir, n, c), new_path(spark, n), RANGE)) for n, c in (("before", F.col("o_orderstatus")), ("after", status))]
    return digests.altered(*sides).withColumnRenamed("name", "month")


@query("idempotent_write", "SELECT * FROM (VALUES (1, true), (2, false), (3, true)) t(step, wrote)")
def idempotent_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").count()
    with tempfile.TemporaryDirectory() as at:
        rows = [(i, A.write_json(f"{at}/n.json", {"n": v})) for i, v in ((1, n), (2, n), (3, n + 1))]
    return frame(spark, rows, "step int, wrote boolean")


@query("rounded_json", """SELECT '{"list":[' || round(min(s_acctbal) / 7, 2) || ',null],"n":' || count(*) || '}' AS json FROM supplier""")
def rounded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "supplier").agg(F.min("s_acctbal").alias("least"), F.count("*").alias("n")).first()
    return frame(spark, [(N.canonical_json(A.rounded_values({"n": r.n, "list": [r.least / 7, float("nan")]}, 2)),)], "json string")


@query("canonical_signature", """SELECT sha256('{' || string_agg('"' || r_name || '":' || r_regionkey, ',' ORDER BY r_name) || '}') AS signature FROM region""")
def canonical_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, [(N.signature({r.r_name: r.r_regionkey for r in table(spark, sf_dir, "region").collect()}),)], "signature string")


# --- guards, splits, small functions --------------------------------------------------------------------------------


@query("leak_guard", "SELECT * FROM (VALUES ('development', false), ('empty', false), ('everything', true)) t(rows, refused)")
def leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir)

    def refused(some: DataFrame) -> bool:
        try:
            splits.assert_no_final_test(some, "o_orderdate", LAST_YEAR)
            return False
        except splits.FinalTestLeak:
            return True

    development = df.where(F.col("o_orderdate") < splits.ntz(LAST_YEAR))
    return frame(spark, [("development", refused(development)), ("empty", refused(df.limit(0))), ("everything", refused(df))], "rows string, refused boolean")


@query("development_window", f"WITH {SERIES} SELECT day, round(y, 6) AS y, month FROM e WHERE day < TIMESTAMP '{LAST_YEAR}' AND month IN (1, 3, 5, 7, 9, 11) UNION ALL SELECT day, round(y, 6), month FROM e WHERE day >= TIMESTAMP '{LAST_YEAR}' AND month IN (2, 4)")
def development_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before a cut in some months, with rows after it in others: the filters and the union of the experiments."""
    df = daily(spark, sf_dir)
    early = DAILY.before(df, LAST_YEAR).where(F.col("month").isin(1, 3, 5, 7, 9, 11))
    return early.unionByName(DAILY.since(df, LAST_YEAR).where(F.col("month").isin(2, 4))).select("day", "y", "month")


@query("extreme_flags", "SELECT event_id, round(value + 273.15, 6) AS kelvin, (event_id % 3 = 0)::INT AS is_extreme_snow, (event_id % 5 = 0)::INT AS is_extreme_thunderstorm, (event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0)::INT AS is_extreme_weather FROM events")
def extreme_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    df = e.withColumns({n: (F.col("event_id") % k == 0).cast("int") for n, k in (("wm_snow", 3), ("wm_thunderstorm", 5), ("wm_squall", 7))})
    return collapse.add_extreme_flags(df).select("event_id", N.celsius_to_kelvin(F.col("value")).alias("kelvin"), "is_extreme_snow", "is_extreme_thunderstorm", "is_extreme_weather")


@query("multi_hot_names", "SELECT i::INT AS nth, 'wm_' || lower(['" + "', '".join(L.MAIN_SEVERITY) + "'][i]) AS name FROM (SELECT unnest(range(1, 12)) AS i)")
def multi_hot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, list(enumerate(L.main_columns(), 1)), "nth int, name string")


@query("label_set_split", "SELECT o_orderdate, string_split(string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority), '; ')[1] AS first, count(DISTINCT o_orderpriority)::INT AS n FROM orders GROUP BY 1")
def label_set_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = orders(spark, sf_dir).groupBy("o_orderdate").agg(L.set_string(F.col("o_orderpriority")).alias("labels"))
    return sets.select("o_orderdate", F.get(L.split_set(F.col("labels")), 0).alias("first"), F.size(L.split_set(F.col("labels"))).alias("n"))


# --- policy and serving ---------------------------------------------------------------------------------------------


@query("policy_states", "SELECT * FROM (VALUES ('check without a file', 2), ('new', 0), ('equal', 0), ('drift', 1), ('forced', 0), ('tampered', 2), ('command', 1)) t(step, code)")
def policy_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit codes of freezing, through the command line for the last."""
    n = orders(spark, sf_dir).count()
    with tempfile.TemporaryDirectory() as at:
        path, decided = Path(at) / "policy.json", {"policy_id": "none", "final_test_used": False, "evidence": {"n": n, "mae": 1.0}}
        other = decided | {"policy_id": "non_negative_projection"}
        near = decided | {"evidence": {"n": n, "mae": 1.2}}
        codes = [("check without a file", P.freeze(decided, path, "a", check=True)[0]), ("new", P.freeze(decided, path, "a")[0]), ("equal", P.freeze(near, path, "b")[0]), ("drift", P.freeze(other, path, "b")[0]), ("forced", P.freeze(other, path, "b", force=True)[0])]
        A.write_json(path, A.read_json(path) | {"policy_id": "none"})
        codes.append(("tampered", P.freeze(other, path, "c")[0]))
        P.freeze(other, path, "d", force=True)
        A.write_json(Path(at) / "candidate.json", decided)
        codes.append(("command", P.main([str(Path(at) / "candidate.json"), str(path), "--check"])))
    return frame(spark, codes, "step string, code int")


@query("policy_differences", "SELECT * FROM (VALUES ('equal', 0), ('evidence within tolerance', 0), ('evidence beyond', 1), ('decision', 1), ('missing key', 1), ('bool for int', 1)) t(kind, n)")
def policy_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = {"policy_id": "none", "n": 1, "evidence": {"mae": 2.0}}
    others = {"equal": a, "evidence within tolerance": a | {"evidence": {"mae": 2.4}}, "evidence beyond": a | {"evidence": {"mae": 2.6}}, "decision": a | {"policy_id": "x"}, "missing key": {k: v for k, v in a.items() if k != "n"}, "bool for int": a | {"n": True}}
    return frame(spark, [(k, len(P.differences(a, b))) for k, b in others.items()], "kind string, n int")


@query("policy_precondition", "SELECT * FROM (VALUES ('none', true), ('signed', false), ('changed since', true), ('chosen on the final test', true)) t(policy, refused)")
def policy_precondition(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = P.sign({"policy_id": "none", "final_test_used": False}, "now")
    rows = []
    for name, p in (("none", None), ("signed", signed), ("changed since", signed | {"policy_id": "x"}), ("chosen on the final test", P.sign({"policy_id": "none", "final_test_used": True}, "now"))):
        try:
            P.require_frozen(p)
            rows.append((name, False))
        except RuntimeError:
            rows.append((name, True))
    return frame(spark, rows, "policy string, refused boolean")


@query(
    "serve_saved_model",
    f"""WITH q AS (SELECT event_id, ts AS date_time, value - 40 AS t FROM events WHERE ts IS NOT NULL), tr AS (SELECT t + 273.15 AS x, 5 * t + event_id % 10 AS y FROM q WHERE t BETWEEN -70 AND 70 AND date_time < TIMESTAMP '{CUT}'),
f AS (SELECT count(*) AS k, avg(x) AS mx, var_pop(x) AS v, covar_pop(x, y) AS c, avg(y) AS my FROM tr),
s AS (SELECT event_id, t, my + k * c / (k + {ALPHA}) * (t + 273.15 - mx) / v AS raw FROM q, f WHERE date_time >= TIMESTAMP '{CUT}')
SELECT event_id AS request_id, CASE WHEN t BETWEEN -70 AND 70 THEN round(greatest(0.0::DOUBLE, raw), 6) END AS prediction, t BETWEEN -70 AND 70 AND raw < 0 AS clipped FROM s""",
)
def serve_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model is trained on request features, saved with its policy in a registry, loaded, and scores requests."""
    e = events(spark, sf_dir).where("ts is not null")
    requests = e.select(F.col("event_id").alias("request_id"), F.col("ts").alias("date_time"), (F.col("value") - 40).alias("temperature_celsius"), F.lit(0.0).alias("rain_1h_mm"), F.lit(0.0).alias("snow_1h_mm"), F.lit(20).alias("clouds_all"), F.array(F.lit("Clear")).alias("weather"), F.lit(None).cast("date").alias("state_fair_start_date"))
    cut = F.lit(CUT).cast("timestamp_ntz")
    train = scoring.features(scoring.validate(requests.where(F.col("date_time") < cut)).where(F.size("errors") == 0)).withColumn("y", 5 * F.col("temperature_celsius") + F.col("request_id") % 10)
    with tempfile.TemporaryDirectory() as at:  # files of the driver alone
        registry = scoring.Registry(at)
        registry.save(ridge.fit(train, "y", ["temp"], alpha=ALPHA), spark.createDataFrame([(0, 0, 0.0)], "hour int, day_of_week int, baseline_pred double"), P.sign({"policy_id": "non_negative_projection", "final_test_used": False}, "now"), {})
        out = registry.score(requests.where(F.col("date_time") >= cut), "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    return out.select("request_id", "prediction", "clipped")


# --- versions over time ---------------------------------------------------------------------------------------------

#: When each version was frozen; the second clips.
FROZEN = ["2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00"]
_SERVED = ", ".join(fitted(f"m{i}", before(a, "hour_ts"), since(a, b, "hour_ts")) for i, (a, b) in enumerate(zip(FROZEN, [*FROZEN[1:], "2100-01-01 00:00:00"], strict=True)))


@query(
    "serve_versions",
    f"WITH {SERIES_H}, {_SERVED}, u AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS version, hour_ts, pred - 3000 AS raw FROM m{i}" for i in range(3)) + """)
SELECT hour_ts, version, round(raw, 6) AS raw, round(CASE WHEN version = 1 AND raw < 0 THEN 0 ELSE raw END, 6) AS prediction, version = 1 AND raw < 0 AS clipped FROM u UNION ALL SELECT hour_ts, NULL, NULL, NULL, NULL FROM e WHERE hour_ts < TIMESTAMP '2024-01-08'""",
)
def serve_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours as requests, scored by the model and policy that were frozen at their time; three versions, kept in a table."""
    df = hourly_series(spark, sf_dir).withColumn("target", F.col("y") - 3000)
    registry = versions.VersionedRegistry(spark, new_path(spark, "registry"))
    models = many.fit_expanding(df, "hour_ts", FROZEN, "target", ["x"], alpha=ALPHA)
    for i, at in enumerate(FROZEN):
        registry.freeze(i, at, models[at], {"policy_id": "non_negative_projection" if i == 1 else "none", "final_test_used": False})
    return registry.score(df, "hour_ts").select("hour_ts", "version", "raw", "prediction", "clipped")


_WEEK = "least(3, (day(ts) - 1) // 7)"
_POLICIES = f"p AS (SELECT event_type, {_WEEK} AS week, count(*) AS n, sum(event_id) AS s, round(avg(value), 3) AS mean, min(value) AS floor FROM events WHERE ts IS NOT NULL GROUP BY ALL)"


def weekly_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, week, content): a policy document of each event type and week, made of its events; where their number is odd it has a note."""
    week = F.least(F.lit(3), F.floor((F.day("ts") - 1) / 7))
    p = events(spark, sf_dir).where("ts is not null").groupBy("event_type", week.cast("long").alias("week")).agg(F.count("*").alias("n"), F.sum("event_id").alias("s"), F.round(F.avg("value"), 3).alias("mean"), F.min("value").alias("floor"))
    note = F.when(F.col("n") % 2 == 1, F.struct(F.lit("odd").alias("why"), F.array(F.col("n") % 3, F.lit(1)).alias("codes")))
    decision = F.struct((F.col("floor") >= 1).alias("floor_not_low"), (F.col("n") > 80).alias("many"))
    content = F.to_json(F.struct(F.when(F.col("s") % 2 == 0, "non_negative_projection").otherwise("none").alias("policy_id"), decision.alias("decision"), (F.col("s") % 5 == 0).alias("final_test_used"), note.alias("note"), F.struct("mean", F.col("n").alias("rows")).alias("evidence")))
    return p.select("event_type", "week", "n", "s", content.alias("content"))


@query(
    "policy_drift",
    f"""WITH {_POLICIES}, d AS (SELECT event_type, week, CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END AS id, floor >= 1 AS low, n > 80 AS many, s % 5 = 0 AS used, n % 2 = 1 AS odd, n % 3 AS code, mean, n FROM p),
j AS (SELECT a.event_type, a.week, a.id <> b.id AS c1, a.low <> b.low AS c2, a.many <> b.many AS c3, a.used <> b.used AS c4, a.odd AS o1, b.odd AS o2, a.code <> b.code AS c5, abs(a.mean - b.mean) > 0.5 AS c6, a.n <> b.n AS c7 FROM d a JOIN d b ON a.event_type = b.event_type AND b.week = a.week + 1),
u AS (SELECT event_type, week, unnest(['policy_id', 'decision.floor_not_low', 'decision.many', 'final_test_used', 'evidence.mean', 'evidence.rows', 'note.why', 'note.codes[0]', 'note.codes[1]']) AS path,
  unnest([CASE WHEN c1 THEN 'differs' END, CASE WHEN c2 THEN 'differs' END, CASE WHEN c3 THEN 'differs' END, CASE WHEN c4 THEN 'differs' END, CASE WHEN c6 THEN 'differs' END, CASE WHEN c7 THEN 'differs' END,
    CASE WHEN o1 AND NOT o2 THEN 'only first' WHEN o2 AND NOT o1 THEN 'only second' END, CASE WHEN o1 AND NOT o2 THEN 'only first' WHEN o2 AND NOT o1 THEN 'only second' WHEN o1 AND c5 THEN 'differs' END, CASE WHEN o1 AND NOT o2 THEN 'only first' WHEN o2 AND NOT o1 THEN 'only second' END]) AS difference FROM j)
SELECT event_type, week, path, difference FROM u WHERE difference IS NOT NULL""",
)
def policy_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each week's policy differs from the next week's, by path."""
    flat = stored(versions.flattened(weekly_policies(spark, sf_dir), ["event_type", "week"], "content"), "leaves")
    weeks = flat.select("event_type", "week").distinct()
    has_next = weeks.join(weeks.withColumn("week", F.col("week") - 1), ["event_type", "week"], "left_semi")
    first = flat.join(has_next, ["event_type", "week"], "left_semi")
    second = flat.withColumn("week", F.col("week") - 1).join(has_next, ["event_type", "week"], "left_semi")
    return versions.differences(first, second, ["event_type", "week"]).select("event_type", "week", "path", "difference")


@query(
    "policy_refusals",
    f"WITH {_POLICIES} SELECT event_type, week, CASE WHEN n % 4 = 0 THEN 'nothing is frozen' WHEN n % 4 = 1 THEN 'changed since' WHEN s % 5 = 0 THEN 'final test used' END AS refused FROM p",
)
def policy_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under which an audit must not run: some are missing, some were changed after they were signed, some were chosen with the final test."""
    docs = weekly_policies(spark, sf_dir)
    signed = docs.withColumn("signature", F.sha2("content", 256))
    content = F.when(F.col("n") % 4 == 1, F.concat(F.lit(" "), F.col("content"))).when(F.col("n") % 4 != 0, F.col("content"))
    return versions.refusals(signed.withColumn("content", content), "content", "signature").select("event_type", "week", "refused")


@query("multi_hot_names_of_data", "SELECT DISTINCT 'wm_' || lower(trim(regexp_replace(o_orderpriority, '[^0-9a-zA-Z]+', '_', 'g'), '_')) AS name, o_orderpriority AS label FROM orders WHERE o_orderpriority IS NOT NULL")
def multi_hot_names_of_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of 0/1 columns that the labels of a table get."""
    labels = orders(spark, sf_dir).where("o_orderpriority is not null").select(F.col("o_orderpriority").alias("label")).distinct()
    return labels.select(F.concat(F.lit("wm_"), L.slug(F.col("label"))).alias("name"), "label")


@query("leak_guard_by_year", "SELECT year(o_orderdate)::INT AS year, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-06-01') AS n_leaked, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-06-01') > 0 AS refused FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def leak_guard_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the guard refuses the orders of each year, and how many of them lie beyond the cut."""
    df = orders(spark, sf_dir).where("o_orderdate is not null").select(F.year("o_orderdate").alias("year"), "o_orderdate")
    counts = df.groupBy("year").agg(F.count_if(F.col("o_orderdate") >= splits.ntz("1998-06-01 00:00:00")).alias("n_leaked")).collect()  # a row a year
    rows = []
    for r in counts:
        try:
            splits.assert_no_final_test(df.where(F.col("year") == r.year), "o_orderdate", "1998-06-01 00:00:00")
            rows.append((r.year, r.n_leaked, False))
        except splits.FinalTestLeak:
            rows.append((r.year, r.n_leaked, True))
    return frame(spark, rows, "year int, n_leaked long, refused boolean")


@query(
    "stream_corrections",
    """WITH e AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, value FROM events WHERE ts IS NOT NULL), c AS (SELECT start, event_type, count(*) AS k FROM e WHERE event_type IS NOT NULL GROUP BY ALL),
m AS (SELECT start, first(event_type ORDER BY k DESC, event_type) AS label_mode, string_agg(event_type, '; ' ORDER BY event_type) AS label_set FROM c GROUP BY 1)
SELECT e.start, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(sum(value), 6) AS total, any_value(label_mode) AS label_mode, any_value(label_set) AS label_set FROM e LEFT JOIN m USING (start) GROUP BY e.start""",
)
def stream_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream in two parts, the second of which comes late: windows are corrected, the last batch is merged once more, and the table is that of all events."""
    source, sink, log = (new_path(spark, name) for name in ("source", "sink", "log"))
    e = events(spark, sf_dir).select("ts", "event_type", "value", F.col("event_id").alias("id"))
    for late in (0, 1):
        e.where((F.col("id") % 7 == 0).cast("int") == late).drop("id").write.mode("append").parquet(source)
        stream = spark.readStream.schema(e.drop("id").schema).parquet(source)
        corrections.run_corrections(corrections.corrected_windows(stream, "ts", "60 days", "1 hour", "event_type", "value"), sink, log)
    last = spark.read.option("basePath", sink).parquet(sink).agg(F.max("batch")).first()[0]
    corrections.merge(stored(spark.read.parquet(f"{sink}/batch={last}"), "replayed"), last, sink)
    return corrections.current(spark, sink).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _train_evaluate_sql() -> str:
    filled = "coalesce(x, m)"
    grid = ", ".join(repr(a) for a in ridge.ALPHAS)
    return f"""WITH {SERIES}, t AS (SELECT * FROM {before("1999-01-01 00:00:00")}), v AS (SELECT * FROM {since("1999-01-01 00:00:00", LAST_YEAR)}), z AS (SELECT * FROM {since(LAST_YEAR)}), mm AS (SELECT quantile_cont(x, 0.5) AS m FROM t),
f AS (SELECT any_value(m) AS m, count(*) AS k, avg({filled}) AS mx, var_pop({filled}) AS w, covar_pop({filled}, y) AS c, avg(y) AS my, min(y) AS floor FROM t, mm), a AS (SELECT unnest([{grid}])::DOUBLE AS alpha),
g AS (SELECT alpha, avg(abs(y - (my + k * c / (k + alpha) * ({filled} - mx) / w))) AS mae FROM v, f, a GROUP BY 1), b AS (SELECT alpha FROM g ORDER BY round(mae, 2), alpha LIMIT 1),
p AS (SELECT month, day_of_week, avg(y) AS bp FROM t GROUP BY ALL), s AS (SELECT z.*, my + k * c / (k + alpha) * ({filled} - mx) / w AS pred, coalesce(bp, my) AS base FROM z LEFT JOIN p USING (month, day_of_week), f, b),
l AS (SELECT unnest(['ridge', 'baseline']) AS model, unnest([pred, base]) AS p, y, month, day_of_week FROM s), u AS (SELECT model, p, y, unnest(['all', 'month', 'day_of_week']) AS segment, unnest(['all', month::VARCHAR, day_of_week::VARCHAR]) AS value FROM l)
SELECT model, segment, value, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(p - y), 6) AS bias FROM u GROUP BY ALL"""


@query("train_evaluate", _train_evaluate_sql())
def train_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuned, fitted, stored with a signed policy, loaded again and judged: the errors of the ridge and the baseline over the test rows and by segment."""
    df = daily(spark, sf_dir)
    with tempfile.TemporaryDirectory() as at:  # files of the driver alone
        training.train(DAILY, df, "1999-01-01 00:00:00", LAST_YEAR, at, "now")
        out = training.evaluate(spark, DAILY, df, LAST_YEAR, at, ["month", "day_of_week"])
    return out.select("model", "segment", "value", "n", "mae", "rmse", "bias")
