import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, collapse, drift, explore, lags, quality, ridge, segments, splits

RAW = "date_time timestamp_ntz, traffic_volume long, holiday string, temp double, rain_1h double, snow_1h double, clouds_all double, weather_main string, weather_description string"


def raw(spark, rows):
    df = spark.createDataFrame(rows, RAW.replace("date_time timestamp_ntz", "date_time string"))
    return df.withColumn("date_time", F.col("date_time").cast("timestamp_ntz"))


GROUP = [
    ("2013-01-01 06:00:00", 30, "None", 310.0, 0.0, 0.0, 60.0, "Clouds", "few clouds"),
    ("2013-01-01 06:00:00", 30, "None", 290.0, 0.0, 0.0, 20.0, "Mist", "mist"),
    ("2013-01-01 06:00:00", 30, "None", 310.0, 55.63, 0.0, 95.0, "Mist", "mist"),
    ("2013-01-01 06:00:00", 30, "None", 296.0, 0.0, 0.0, 50.0, "Squall", "SQUALLS"),
    ("2013-01-01 07:00:00", 31, "None", 0.0, 9831.3, 0.0, 40.0, "Rain", "light rain"),
    ("2013-01-01 07:00:00", 31, "None", 0.0, 9831.3, 0.0, 40.0, "Clear", "sky is clear"),
    ("2013-01-01 09:00:00", 9, "New Years Day", 280.0, 0.0, 0.0, 1.0, "Clear", "Sky is Clear"),
]


def test_collapse(spark):
    want = None
    for seed in range(3):
        rows = list(GROUP)
        random.Random(seed).shuffle(rows)
        out = sorted(r.asDict().items() for r in collapse.collapse_weather(raw(spark, rows).repartition(3)).orderBy("date_time").collect())
        want = want or out
        assert out == want
    a, b, _ = (dict(x) for x in sorted((dict(w) for w in want), key=lambda d: d["date_time"]))
    assert (a["temp"], a["clouds_all"], a["rain_1h"], a["n_weather_obs"]) == (303.0, 55.0, 0.0, 4)
    assert (a["weather_main_mode"], a["weather_main_set"], a["weather_main_n"], a["weather_severity"], a["weather_family"]) == ("Mist", "Clouds; Mist; Squall", 3, 4, "thunder")
    assert (a["wm_squall"], a["wm_clear"]) == (1, 0)
    assert b["weather_main_mode"] == "Clear"  # a tie


def test_extreme_flags(spark):
    out = collapse.add_extreme_flags(collapse.collapse_weather(raw(spark, GROUP))).orderBy("date_time").collect()
    assert [r.is_extreme_weather for r in out] == [1, 0, 0] and out[0].is_extreme_squall == 1


def test_invalid_values(spark):
    clean, stats = quality.flag_invalid(raw(spark, GROUP), ["temp"], {"rain_1h": [9831.3]})
    s = stats.first()
    assert (s.invalid_temp, s.invalid_rain_1h, s.null_temp) == (2, 2, 2)
    assert clean.agg(F.max("rain_1h")).first()[0] == 55.63


def test_duplicates_and_invariants(spark):
    df = raw(spark, GROUP)
    s = quality.duplicate_audit(df, ["date_time"], ["traffic_volume", "weather_main"]).first()
    assert (s.n_rows, s.n_groups, s.n_duplicate_groups, s.rows_in_duplicates, s.min_size, s.max_size, s.varies_traffic_volume, s.varies_weather_main) == (7, 3, 2, 6, 2, 4, 0, 2)
    quality.assert_invariants(df, ["date_time"], ["traffic_volume", "holiday"])
    broken = df.unionByName(raw(spark, [("2013-01-01 09:00:00", 10, "None", 280.0, 0.0, 0.0, 1.0, "Clear", "x")]))
    with pytest.raises(ValueError, match="holiday, traffic_volume"):
        quality.assert_invariants(broken, ["date_time"], ["traffic_volume", "holiday"])


def test_coverage(spark):
    df = raw(spark, GROUP)
    c = quality.coverage(df, "date_time").first()
    assert (c.expected, c.present, c.missing, c.missing_ratio) == (4, 3, 1, 0.25)
    assert [str(r.missing) for r in quality.missing_steps(df, "date_time").collect()] == ["2013-01-01 08:00:00"]
    assert quality.missing_steps(df.limit(0), "date_time").collect() == []
    assert [(r.holiday, r.n_rows, r.n_days) for r in quality.holiday_audit(df, "date_time", "holiday").collect()] == [("New Years Day", 1, 1)]


def test_coerce(spark):
    df = spark.createDataFrame([("2013-01-01 06:00:00", "1.5", None), ("never", "x", "a")], "t string, v string, s string")
    out = quality.coerce(df, ["t"], ["v"], strings=["s"]).collect()
    assert (out[0].v, out[0].s, out[1].t, out[1].v) == (1.5, "", None, None)
    kept, bad = quality.drop_bad_times(quality.coerce(df, ["t"]), "t")
    assert kept.count() == 1 and quality.coerce(df, ["t"]).agg(bad).first()[0] == 1
    with pytest.raises(KeyError):
        quality.drop_bad_times(df, "date_time")
    assert quality.schema_check(df, ["t", "u"]) == {"missing": ["u"], "extra": ["s", "v"]}


def series(spark, hours, values=None):
    values = values or [100.0 * (i + 1) for i in range(len(hours))]
    df = spark.createDataFrame(list(zip(hours, values, strict=True)), "h int, y double")
    return df.select((F.lit("2013-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))).alias("t"), "y", F.lit(1).alias("k"))


def test_lags(spark):
    df = series(spark, [0, 1, 5, 6])
    by_time = {r.t.hour: r.lag_1h for r in lags.lag_by_time(df, "t", "y", [1]).collect()}
    assert by_time == {0: None, 1: 100.0, 5: None, 6: 300.0}
    assert {r.t.hour: r.lag_1h for r in lags.lag_by_range(df, "t", "y", [1], ["k"]).collect()} == by_time
    assert {r.t.hour: r.shift_1 for r in lags.lag_by_row(df, "t", "y", [1]).collect()} == {0: None, 1: 100.0, 5: 200.0, 6: 300.0}
    several = spark.sql("select timestamp_ntz'2024-01-01 20:00:00' + make_dt_interval(0, cast(id * 5 as int)) t, cast(id as double) y, 1 k from range(12) union all select null, -1D, 1")
    shifts = lambda by: sorted(((r.y, r.shift_1, r.shift_3) for r in lags.lag_by_row(several, "t", "y", [1, 3], by).collect()), key=str)
    assert shifts([]) == shifts(["k"])  # days, a null time
    sparse = lags.lag_by_time(series(spark, [0, 3]), "t", "y", [1, 24])
    assert all(r.lag_1h is None and r.lag_24h is None for r in sparse.collect())
    kept, stats = splits.complete_rows(lags.lag_by_time(df, "t", "y", [1]), ["lag_1h"])
    assert kept.count() == 2 and stats.first().kept_pct == 50.0


def test_splits_and_guards(spark):
    df = series(spark, list(range(100)))
    cuts = ("2013-01-03 00:00:00", "2013-01-04 00:00:00")
    parts = splits.with_split(df, "t", *cuts)
    rows = {r.split: r.n for r in splits.assert_disjoint(parts, "t").collect()}
    assert rows == {"train": 48, "validation": 24, "test": 28}
    assert [x.count() for x in splits.time_split(df, "t", *cuts)] == [48, 24, 28]
    with pytest.raises(AssertionError, match="empty"):
        splits.assert_disjoint(parts.where("split <> 'test'"), "t")
    with pytest.raises(AssertionError, match="begins"):
        splits.assert_disjoint(parts.withColumn("split", F.expr("CASE WHEN hour(t) = 0 THEN 'test' ELSE split END")), "t")
    with pytest.raises(splits.FinalTestLeak):
        splits.assert_no_final_test(df, "t", cuts[0])
    splits.assert_no_final_test(df.limit(0), "t", cuts[0])
    splits.assert_no_final_test(df.where(F.col("t") < splits.ntz(cuts[0])), "t", cuts[0])


def test_random_split_is_exact_and_survives_repartitioning(spark):
    df = spark.range(1001)
    a = {r.id: r.split for r in splits.random_split(df, ["id"], 5).collect()}
    b = {r.id: r.split for r in splits.random_split(df.repartition(7), ["id"], 5).collect()}
    c = {r.id: r.split for r in splits.random_split(df, ["id"], 6).collect()}
    assert a == b != c
    assert [list(a.values()).count(k) for k in ("train", "validation", "test")] == [700, 150, 151]
    assert sorted(r.id for r in splits.sample_rows(df, ["id"], 5, 10).collect()) == sorted(r.id for r in splits.sample_rows(df.repartition(3), ["id"], 5, 10).collect())


def test_segments(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 1, 0), (1, 4.0, 2.0, 0, 0), (2, 1.0, 1.0, 1, 1)], "g int, y double, pred double, f int, h int")
    r = {x.g: x for x in segments.report(df, ["g"]).collect()}
    assert (r[1].n, r[1].mae, r[1].bias, r[1].small_sample) == (2, 1.5, -0.5, True)
    full = {x.g: x for x in segments.with_all_segments(segments.report(df, ["g"]), spark.range(1, 4).select(F.col("id").cast("int").alias("g")), ["g"]).collect()}
    assert full[3].n == 0 and full[3].mae is None and full[3].small_sample
    flags = {x.label: x.n for x in segments.report_by_flags(df, ["f", "h"]).collect()}
    assert flags == {"f": 2, "h": 1, "any": 2, "none": 1}


def test_relative_errors_need_a_positive_mean(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 2.0), (2, 2.0, 1.0, 4.0)], "g int, y double, a double, b double")
    r = {x.g: x for x in segments.compare_by(df, "g", "y", "a", "b").collect()}
    assert r[1].rel_a is None and r[2].rel_a == 0.5 and r[2].a_worse is False


def test_psi(spark):
    rng = np.random.default_rng(0)
    rows = [(2013, float(v)) for v in rng.normal(0, 1, 900)] + [(2014, float(v)) for v in rng.normal(0, 1, 900)] + [(2015, float(v)) for v in rng.normal(2, 1, 900)] + [(2016, 1.0)] * 5
    df = spark.createDataFrame(rows, "year int, v double")
    out = {r.year: r for r in drift.psi(df, "v", "year", 2013).collect()}
    ref = np.array([v for y, v in rows if y == 2013])
    edges = np.unique(np.percentile(ref, np.arange(10, 100, 10)))
    for y in (2014, 2015, 2016):
        o, b = (np.maximum(np.bincount(np.searchsorted(edges, np.array([v for k, v in rows if k == yy]), "right"), minlength=10) / sum(k == yy for k, _ in rows), 1e-6) for yy in (y, 2013))
        assert out[y].psi == pytest.approx(float(((o - b) * np.log(o / b)).sum()), abs=1e-5)
    assert out[2014].verdict == "stable" and out[2015].verdict == "shifted"
    rough = {r.year: r.psi for r in drift.psi(df, "v", "year", 2013, exact=False).collect()}
    assert rough[2015] == pytest.approx(out[2015].psi, rel=0.05)
    flat = spark.createDataFrame([(2013, 1.0), (2014, 1.0)], "year int, v double")
    assert drift.psi(flat, "v", "year", 2013).first().psi == 0.0
    assert [drift.trend(1, x) for x in (1.2, 0.8, 1.05)] == ["worse", "better", "flat"]


def test_bootstrap(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2013-01-01', TIMESTAMP_NTZ'2013-01-06 23:00:00', INTERVAL 1 HOUR)) AS t").select(F.to_date("t").alias("day"), F.lit(10.0).alias("y"), (F.lit(10.0) + F.hour("t") % 3).alias("a"), (F.lit(10.0) + F.dayofmonth("t")).alias("b"))
    sums = bootstrap.block_sums(df, "day", "y", "a", "b")
    assert sums.count() == 6
    one, same, other = (sorted(r.d_mae for r in bootstrap.draws(sums, 100, s).collect()) for s in (1, 1, 2))
    assert one == same != other and len(one) == 100
    i = bootstrap.interval(bootstrap.draws(sums, 500, 1), "d_mae").first()
    point = 3.5 - 1.0
    assert i.ci_low < point < i.ci_high and i.n_draws == 500


def ridge_frame(spark, n=400):
    rng = random.Random(0)
    rows = [(rng.gauss(0, 2) if i % 9 else None, rng.choice("abc"), i % 2, rng.gauss(0, 1), "train" if i % 4 else "test") for i in range(n)]
    return spark.createDataFrame([(x, c, b, 3 * (x or 0) + {"a": 1, "b": 5, "c": 9}[c] + b + e, s) for x, c, b, e, s in rows], "x double, c string, b int, y double, s string")


def test_ridge_equals_the_closed_form(spark):
    df = ridge_frame(spark)
    train, test = df.where("s = 'train'"), df.where("s = 'test'")
    for alpha in (0.001, 10.0, 1000.0):
        model = ridge.fit(train, "y", ["x"], ["c"], ["b"], alpha)
        tr, te = train.collect(), test.collect()
        med = float(np.median([r.x for r in tr if r.x is not None]))
        xs = np.array([r.x if r.x is not None else med for r in tr])
        mean, sd = xs.mean(), xs.std()
        row = lambda r: [((r.x if r.x is not None else med) - mean) / sd, *(float(r.c == k) for k in "abc"), r.b]  # noqa: B023, E731
        a, b, y = np.array([row(r) for r in tr]), np.array([row(r) for r in te]), np.array([r.y for r in tr])
        ac = a - a.mean(0)
        w = np.linalg.solve(ac.T @ ac + alpha * np.eye(5), ac.T @ (y - y.mean()))
        want = (b - a.mean(0)) @ w + y.mean()
        got = [r.pred for r in model.predict(test).collect()]
        assert np.abs(np.array(got) - want).max() < 1e-6
    assert model.medians == {"x": pytest.approx(med)}


def test_ridge_learns_from_training_rows_alone(spark):
    df = ridge_frame(spark)
    train = df.where("s = 'train'")
    model = ridge.fit(train, "y", ["x"], ["c"], ["b"])
    odd = spark.createDataFrame([(1e6, "never seen", 1), (None, None, None)], "x double, c string, b int")
    assert all(r.pred is not None for r in model.predict(odd).collect())
    again = ridge.fit(train.repartition(5), "y", ["x"], ["c"], ["b"])
    assert again.medians == model.medians and again.scales == pytest.approx(model.scales)
    with pytest.raises(ValueError):
        ridge.fit(df.limit(0), "y", ["x"])


def test_tuning_takes_the_first_of_equals(spark):
    df = ridge_frame(spark, 120)
    best, rows = ridge.tune(df.where("s = 'train'"), df.where("s = 'test'"), "y", (0.001, 0.002, 1e6), digits=1, numeric=["x"], categorical=["c"], binary=["b"])
    assert best == 0.001 and len(rows) == 3
    s = ridge.sensitivity(rows, best)
    assert s["on_edge"] and 1e6 not in s["as_good"]


def test_explore(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2013-02-01', TIMESTAMP_NTZ'2013-03-02', INTERVAL 1 DAY)) AS t").withColumn("y", F.dayofmonth("t").cast("double"))
    grid = explore.month_year_mean(df, "t", "y").orderBy("month").collect()
    assert len(grid) == 12 and grid[0].mean is None and grid[0].n == 0 and grid[1].n == 28
    d = explore.describe(df, "y").first()
    assert (d.n, d.least, d.greatest, d.median) == (30, 1.0, 28.0, 13.5)
    assert explore.describe(df, "y", exact=False).first().median in (13.0, 14.0)
    assert {r.value: r.n for r in explore.value_counts(df.withColumn("m", F.month("t")), "m").collect()} == {2: 28, 3: 2}
