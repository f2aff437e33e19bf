"""Many models and windows from one set of sums; lags in one shuffle; runs of missing steps; quantiles by digits."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, drift, lags, many, quality, quantiles, ridge

HOUR = timedelta(hours=1)
START = datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        x = None if rng.random() < 0.1 else rng.gauss(1000, 50)
        cat, flag = rng.choice("abcd"), rng.random() < 0.3
        y = None if rng.random() < 0.02 else 3 * ((x or 990) - 1000) + {"a": 5, "b": -9, "c": 0, "d": 40}[cat] + 7 * flag + rng.gauss(0, 3)
        rows.append((START + i * 3 * HOUR, x, cat, int(flag) if rng.random() > 0.05 else None, y, i % 4))
    return spark.createDataFrame(rows, "t timestamp_ntz, x double, cat string, flag int, y double, part long").cache()


def same(a, b):
    assert a.medians == pytest.approx(b.medians) and a.means == pytest.approx(b.means) and a.scales == pytest.approx(b.scales)
    assert a.weights == pytest.approx(b.weights, abs=1e-7) and a.intercept == pytest.approx(b.intercept, abs=1e-6)
    for c in a.levels:
        assert a.levels[c] == pytest.approx(b.levels[c], abs=1e-7)


FEATURES = {"numeric": ["x"], "categorical": ["cat"], "binary": ["flag"]}


def test_models_of_groups_equal_models_fitted_alone(series):
    models, rows = many.fit_many(series, "y", "part", alpha=2.0, **FEATURES)
    for k in range(4):
        part = series.where(F.col("part") == k)
        same(models[k], ridge.fit(part, "y", alpha=2.0, **FEATURES))
        assert rows[k] == part.where("y is not null").count()


def test_expanding_windows_equal_models_fitted_alone(series):
    cuts = ["2020-02-10 00:00:00", "2020-01-20 12:00:00", "2020-04-01 00:00:00"]
    models = many.fit_expanding(series, "t", cuts, "y", alpha=2.0, **FEATURES)
    until = ["2020-02-20 00:00:00", "2020-02-15 00:00:00", "2020-05-01 00:00:00"]
    scored = many.score_windows(series, "t", cuts, until, models, "y", ["cat"])
    for i, (a, b) in enumerate(zip(cuts, until)):
        train = series.where(F.col("t") < F.lit(a).cast("timestamp_ntz"))
        alone = ridge.fit(train, "y", alpha=2.0, **FEATURES)
        same(models[a], alone)
        test = series.where((F.col("t") >= F.lit(a).cast("timestamp_ntz")) & (F.col("t") < F.lit(b).cast("timestamp_ntz")))
        means = {r.cat: r.m for r in train.groupBy("cat").agg(F.avg("y").alias("m")).collect()}
        want = {r.t: (r.pred, means[r.cat]) for r in alone.predict(test).collect()}
        got = {r.t: (r.pred, r.base) for r in scored.where(F.col("fold") == i).collect()}
        assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)


def test_sums_of_parts_add_up_and_levels_are_bounded(series, monkeypatch):
    parts = ridge.sums_by(series, "y", ["part"], **FEATURES)
    whole = ridge.sums_by(series, "y", [], **FEATURES)[()]
    total = parts[0,] + parts[1,] + parts[2,] + parts[3,]
    assert total.n == whole.n and total.p == pytest.approx(whole.p) and total.pair == whole.pair and total.level.keys() == whole.level.keys()
    monkeypatch.setattr(ridge, "MAX_CELLS", 3)
    with pytest.raises(ValueError, match="levels"):
        ridge.sums_by(series, "y", [], **FEATURES)


def test_draws_of_groups_equal_draws_alone(series):
    rows = series.where("y is not null").select(F.to_date("t").alias("day"), "y", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), "part")
    sums = bootstrap.block_sums(rows, "day", "y", "a", "b", by=["part"])
    got = {(r.part, r.draw): (r.d_mae, r.d_rmse) for r in bootstrap.draws_by(sums, 20, "part", {k: 100 + k for k in range(4)}).collect()}
    for k in range(4):
        alone = bootstrap.draws(bootstrap.block_sums(rows.where(F.col("part") == k), "day", "y", "a", "b"), 20, 100 + k).collect()
        assert all(got[k, r.draw] == pytest.approx((r.d_mae, r.d_rmse)) for r in alone) and len(alone) == 20


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("by", [[], ["k"]])
def test_lags_equal_a_lookup_with_one_exchange(spark, by):
    rng = random.Random(2)
    rows = [(START + rng.randrange(0, 300) * HOUR if rng.random() > 0.03 else None, float(rng.randrange(1000)) if rng.random() > 0.05 else None, rng.choice("ab"), "x") for _ in range(250)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double, k string, at string").repartition(6)
    hours = [1, 24, 168]
    best = {}
    for t, v, k, _ in rows:
        if t is not None and v is not None:
            key = (t, k if by else "")
            best[key] = max(best.get(key, v), v)
    want = sorted(((t, v, k, *(best.get((t - h * HOUR, k if by else "")) if t else None for h in hours)) for t, v, k, _ in rows), key=str)
    for out in (lags.lag_by_time(df, "t", "v", hours, by), lags.lag_by_range(df, "t", "v", hours, by)):
        assert out.columns == ["t", "v", "k", "at", "lag_1h", "lag_24h", "lag_168h"]
        assert sorted(((r.t, r.v, r.k, r.lag_1h, r.lag_24h, r.lag_168h) for r in out.collect()), key=str) == want
    assert exchanges(lags.lag_by_time(df, "t", "v", hours, by)) == 1
    assert lags.lag_by_range(df, "t", "v", hours).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_runs_of_missing_steps(spark):
    rng = random.Random(3)
    rows = [(k, START + h * HOUR + timedelta(minutes=rng.randrange(60))) for k in "ab" for h in range(400) if rng.random() < 0.4] + [("c", START), ("d", START), ("d", START + 8761 * HOUR), ("e", None)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    want = []
    for k in "abcd":
        hours = sorted({(t - START) // HOUR for g, t in rows if g == k})
        want += [(k, START + (a + 1) * HOUR, START + (b - 1) * HOUR, b - a - 1) for a, b in zip(hours, hours[1:]) if b - a > 1]
    for bucket in (7, 4096):
        assert sorted(tuple(r) for r in quality.missing_runs(df, "t", "HOUR", ["k"], bucket).collect()) == sorted(want)
    assert ("d", START + HOUR, START + 8760 * HOUR, 8760) in want  # a year without rows is one row
    assert sum(n for *_, n in want) == quality.missing_steps(df, "t", "HOUR", ["k"]).count()
    assert quality.missing_runs(df.limit(0), "t").collect() == []


def test_columns_that_vary(spark):
    rows = [(1, 1.0, "a"), (1, 1.0, "a"), (2, None, "a"), (2, 2.0, "b"), (3, None, None), (3, None, None), (None, 5.0, "x"), (None, 6.0, "x")]
    df = spark.createDataFrame(rows, "k long, x double, s string")
    audit = quality.duplicate_audit(df, ["k"], ["x", "s"]).first()
    assert (audit.n_groups, audit.varies_x, audit.varies_s) == (4, 2, 1)
    got = {(r.k, r.column_name): r.n_values for r in quality.invariant_violations(df, ["k"], ["x", "s"]).collect()}
    assert got == {(2, "x"): 2, (2, "s"): 2, (None, "x"): 2}


def test_quantiles_by_digits_equal_percentiles(spark, series, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice("ab") if rng.random() > 0.1 else None, rng.choice([rng.gauss(0, 1e-6), rng.uniform(-1e9, 1e9), 7.0, 7.0, None]), float(rng.randrange(5))) for _ in range(800)] + [("one", 3.5, None), ("inf", float("inf"), 1.0), ("inf", 1.0, 1.0), ("inf", float("-inf"), 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, z double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    want = {(r.k, c): r[c] for r in df.groupBy("k").agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in "xz")).collect() for c in "xz" if r[c] is not None}
    got = {(r.k, r.column_name, r.share): r.value for r in quantiles.quantiles(df, ["x", "z"], shares, ["k"]).collect()}
    assert len(got) == sum(len(v) for v in want.values())
    for (k, c), values in want.items():
        for s, v in zip(shares, values):
            assert got[k, c, s] == pytest.approx(v, rel=1e-12), (k, c, s)
    assert quantiles.quantiles(df.limit(0), ["x"], [0.5]).collect() == []
    before, psi = ridge.fit(series, "y", ["x"]), sorted(tuple(r) for r in drift.psi(series, "x", "part", 0).collect())
    monkeypatch.setattr(quantiles, "BUFFER_ROWS", 0)
    same(ridge.fit(series, "y", ["x"]), before)
    assert sorted(tuple(r) for r in drift.psi(series, "x", "part", 0).collect()) == psi
