"""Experiments, policy, scoring, sources and streams."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import add_calendar_features
from tidemark.operators import ridge, splits
from tidemark.plans import experiments as X
from tidemark.plans import policy as P
from tidemark.plans import scoring as S
from tidemark.sources import artifacts as A
from tidemark.sources import raw
from tidemark.streaming import windows as W


@pytest.fixture(scope="module")
def dev(spark):
    """Three years of every sixth hour; the target follows hour, weekday and a slow trend, with fixed noise."""
    t = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2015-01-01', TIMESTAMP_NTZ'2017-12-31 18:00:00', INTERVAL 6 HOUR)) AS date_time")
    df = add_calendar_features(t, "date_time")
    noise = F.pmod(F.xxhash64("date_time"), F.lit(1000)) / 100.0
    y = 100 + 10 * F.col("hour") - 15 * F.col("is_weekend") + F.datediff(F.to_date("date_time"), F.lit(date(2015, 1, 1))) / 30 + noise
    return df.withColumn("y", y.cast("double")).withColumn("temp", (noise * 2).cast("double")).cache()


SETUP = X.Setup(time="date_time", y="y", keys=["date_time"], final_test="2018-01-01 00:00:00", numeric=["temp"], categorical=["hour_dow", "month"], alpha=0.1)
SEEDS = (1, 2)


def test_random_against_time(dev):
    out = X.random_vs_time(SETUP, dev, "2017-01-01 00:00:00", SEEDS)
    assert out["own_rows"]["n"] == 2 and out["same_rows"]["mean"] < 0  # the series drifts, so later rows are harder


def test_arms(dev):
    out = X.training_arms(SETUP, dev, "2016-01-01 00:00:00", "2017-01-01 00:00:00", SEEDS)
    assert out["D"]["median_rows"] == out["B"]["median_rows"] < out["C"]["median_rows"]
    assert out["C"]["mean"] < out["B"]["mean"] < out["A"]["mean"]
    assert X.alternate_months(SETUP, dev, "2017-01-01 00:00:00")["P2"]["mae"] < out["A"]["mean"]


def test_rolling_origin_and_night(dev):
    cuts, until = ["2016-01-01 00:00:00", "2017-01-01 00:00:00"], ["2017-01-01 00:00:00", "2018-01-01 00:00:00"]
    out = X.rolling_origin(SETUP, dev, cuts, until)
    assert len(out["folds"]) == 2 and len(out["by_month"]) == 12 and {r["season"] for r in out["by_season"]} == {"Winter", "Spring", "Summer", "Fall"}
    assert sum(r["n"] for r in out["by_month"]) == sum(f["n"] for f in out["folds"])
    night = X.night_hours(SETUP, dev, cuts, until)
    assert len(night) == 2 and {r["_hour"] for r in night[0]["by_hour"]} == {0, 6, 12, 18} and set(night[0]["parts"]) == {"night", "day"}


def test_other_experiments(dev):
    assert set(X.covariate_drift(SETUP, dev, ["temp"], 2015)["psi"]["temp"]) == {2016, 2017}
    assert X.log_target(SETUP, dev, "2017-01-01 00:00:00")["log"]["n"] == X.log_target(SETUP, dev, "2017-01-01 00:00:00")["linear"]["n"]
    train, validation = SETUP.before(dev, "2017-01-01 00:00:00"), SETUP.since(dev, "2017-01-01 00:00:00")
    found = X.alpha_sensitivity(SETUP, train, validation, (0.0, 0.1, 1e5))
    assert found["best"] != 1e5 and len(found["rows"]) == 3
    bias = X.test_window_bias(SETUP, train, validation)
    assert bias["n"] == bias["n_first"] + bias["n_rest"] and len(bias["worst"]) == 3
    lagged = X.lag_leak(SETUP, dev, "2017-01-01 00:00:00", (6, 24), (1,))
    assert set(lagged) == {"none", "time", "row"} and lagged["time"]["time"]["mae"] < lagged["none"]["time"]["mae"]


def test_audit(dev):
    train, test = SETUP.before(dev, "2017-01-01 00:00:00"), SETUP.since(dev, "2017-01-01 00:00:00")
    out = X.audit_window(SETUP, SETUP.both(train, test), 50, 3)
    assert out["d_mae"]["ci_low"] <= out["d_mae"]["point"] <= out["d_mae"]["ci_high"] and len(out["months"]) == 12


def test_verdict():
    window = lambda point, pct, sure: {"d_mae": {"point": point, "better_pct": pct, "excludes_zero": sure, "ci_low": 0.0, "ci_high": 1.0}, "months": [1, 2], "months_won": 1}
    assert X.verdict(window(1.0, 99.0, True), [window(1.0, 60.0, False), window(-1.0, 40.0, False)]) == {
        "final": "better", "interval": [0.0, 1.0], "point": 1.0, "months": "1/2", "windows_better": 1, "n_windows": 2, "all_windows_agree": False,
    }
    assert X.verdict(window(0.1, 60.0, False), [])["final"] == "probably_better" and X.verdict(window(-0.1, 40.0, False), [])["final"] == "not_better"


def test_folders(monkeypatch, tmp_path):
    from tidemark.config import folder

    assert folder("models", "x").as_posix() == "x/models"
    monkeypatch.setenv("TIDEMARK_MODELS_DIR", str(tmp_path))
    assert folder("models") == tmp_path
    with pytest.raises(KeyError):
        folder("other")


def test_baseline_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 2.5), (23, 6, 7.0)], "hour int, day_of_week int, baseline_pred double")
    raw.write_csv(df, str(tmp_path / "b"))
    assert sorted(raw.load_baseline(spark, str(tmp_path / "b")).collect()) == sorted(df.collect())


def test_every_experiment_refuses_the_final_test(spark, dev):
    late = dev.limit(1).withColumn("date_time", F.lit("2018-01-01").cast("timestamp_ntz"))
    bad = dev.unionByName(late)
    calls = [
        lambda: X.random_vs_time(SETUP, bad, "2017-01-01"), lambda: X.training_arms(SETUP, bad, "2016-01-01", "2017-01-01"), lambda: X.alternate_months(SETUP, bad, "2017-01-01"),
        lambda: X.rolling_origin(SETUP, bad, ["2017-01-01"], ["2018-01-01"]), lambda: X.covariate_drift(SETUP, bad, ["temp"], 2015), lambda: X.night_hours(SETUP, bad, ["2017-01-01"], ["2018-01-01"]),
        lambda: X.log_target(SETUP, bad, "2017-01-01"), lambda: X.alpha_sensitivity(SETUP, dev, bad), lambda: X.test_window_bias(SETUP, dev, bad), lambda: X.lag_leak(SETUP, bad, "2017-01-01"),
        lambda: X.run_all(SETUP, bad, "2016-01-01", "2017-01-01", "2017-01-01", [], [], [], 2015), lambda: SETUP.fit(bad),
    ]
    for call in calls:
        with pytest.raises(splits.FinalTestLeak):
            call()


def scored(spark, rows):
    return spark.createDataFrame(rows, "y double, pred double")


def test_policy(spark, tmp_path):
    train, validation = scored(spark, [(1.0, -2.0), (5.0, 6.0)]), scored(spark, [(0.5, -1.0), (2.0, 2.5)])
    found = P.decide(train, validation, "y", "pred")
    assert found["policy_id"] == "non_negative_projection" and found["evidence"]["validation"]["never_worse"]
    assert P.decide(scored(spark, [(-1.0, -2.0)]), validation, "y", "pred")["policy_id"] == "none"
    assert P.decide(scored(spark, [(1.0, 2.0)]), scored(spark, [(1.0, 2.0)]), "y", "pred")["policy_id"] == "none"
    path = tmp_path / "policy.json"
    assert P.freeze(found, path, "now", check=True)[0] == 2 and not path.exists()
    assert P.freeze(found, path, "now") == (0, "frozen")
    before = path.read_bytes()
    assert P.freeze(found, path, "later") == (0, "equal") and path.read_bytes() == before
    other = json.loads(json.dumps(found))
    other["floor"] = 2.0
    code, text = P.freeze(other, path, "later")
    assert code == 1 and "floor" in text and path.read_bytes() == before
    assert P.freeze(other, path, "later", check=True, force=True)[0] == 1
    assert P.freeze(other, path, "later", force=True)[0] == 0
    broken = A.read_json(path) | {"policy_id": "none"}
    A.write_json(path, broken)
    assert P.freeze(other, path, "x")[0] == 2
    with pytest.raises(RuntimeError):
        P.require_frozen(broken)
    with pytest.raises(RuntimeError):
        P.require_frozen(None)
    signed = P.sign(found, "now")
    assert P.require_frozen(signed) is signed


def test_differences():
    a = {"evidence": {"x": 1.0, "n": 3, "b": True}, "z": 1.0}
    assert P.differences(a, {"evidence": {"x": 1.4, "n": 3, "b": True}, "z": 1.0}) == []
    assert P.differences(a, {"evidence": {"x": 1.6, "n": 3, "b": True}, "z": 1.0})
    assert P.differences(a, {"evidence": {"x": 1.0, "n": 4, "b": True}, "z": 1.0})
    assert P.differences(a, {"evidence": {"x": 1.0, "n": 3, "b": 1}, "z": 1.0})
    assert P.differences(a, {"evidence": {"x": 1.0, "n": 3, "b": True}, "z": 1.1})
    assert P.differences([1], [1, 2]) and P.differences({"a": 1}, {})


REQUEST = "request_id int, date_time timestamp_ntz, temperature_celsius double, rain_1h_mm double, snow_1h_mm double, clouds_all int, weather array<string>, state_fair_start_date date"


def requests(spark, *rows):
    base = {"date_time": datetime(2018, 6, 15, 8), "temperature_celsius": 20.0, "rain_1h_mm": 0.0, "snow_1h_mm": 0.0, "clouds_all": 20, "weather": ["Clear"], "state_fair_start_date": None}
    return spark.createDataFrame([(i, *(base | r).values()) for i, r in enumerate(rows)], REQUEST)


def test_validation(spark):
    df = requests(spark, {}, {"temperature_celsius": 293.0}, {"weather": []}, {"weather": ["Hail", "Rain"]}, {"clouds_all": 101}, {"date_time": datetime(1899, 1, 1)}, {"state_fair_start_date": date(2019, 8, 1)}, {"temperature_celsius": None, "rain_1h_mm": -1.0}, {"rain_1h_mm": None})
    got = [[f"{e.field}:{e.code}" for e in r.errors] for r in S.validate(df).orderBy("request_id").collect()]
    assert got == [[], ["temperature_celsius:range"], ["weather:missing"], ["weather:unknown"], ["clouds_all:range"], ["date_time:range"], ["state_fair_start_date:other_year"], ["temperature_celsius:missing", "rain_1h_mm:range"], []]
    with pytest.raises(ValueError, match="extra_field"):
        S.validate(df.withColumn("extra_field", F.lit(1)))


def test_features_and_warnings(spark):
    df = requests(
        spark, {"weather": ["Snow", "Rain", "Rain"]}, {"date_time": datetime(2030, 8, 22, 8), "state_fair_start_date": date(2030, 8, 22), "rain_1h_mm": None, "weather": ["Drizzle"]}, {"snow_1h_mm": None},
    )
    a, b, c = S.warnings(S.features(df), "2012-10-02 09:00:00", "2018-09-30 23:00:00").orderBy("request_id").collect()
    assert (a.weather_main_mode, a.weather_main_set, a.weather_main_n, a.weather_family, a.weather_severity, a.wm_snow, a.wm_clear, a.is_extreme_weather) == ("Rain", "Rain; Snow", 2, "snow", 3, 1, 0, 1)
    assert a.temp == pytest.approx(293.15) and a.warnings == [] and a.is_holiday == 0 and a.hour_dow == "8_4"
    assert b.warnings == ["outside_range", "state_fair_unknown", "rain_missing_but_implied"] and (b.holiday_name, b.is_holiday) == ("State Fair", 1)
    assert c.warnings == ["snow_missing"]


def test_scoring_path(spark):
    train = S.features(requests(spark, *({"temperature_celsius": float(t)} for t in range(-20, 20)))).withColumn("y", F.col("temperature_celsius") * 2)
    model = ridge.fit(train, "y", ["temp"], ["hour_dow"], ["is_holiday"], 0.001)
    df = requests(spark, {"temperature_celsius": 10.0}, {"temperature_celsius": -10.0}, {"temperature_celsius": 500.0})
    out = S.score(df, model, "2012-01-01 00:00:00", "2019-01-01 00:00:00", {"policy_id": "non_negative_projection"}).orderBy("request_id").collect()
    assert out[0].prediction == pytest.approx(20, abs=0.1) and not out[0].clipped
    assert out[1].prediction == 0 and out[1].clipped and out[1].raw_prediction == pytest.approx(-20, abs=0.1)
    assert out[2].prediction is None and out[2].errors
    none = S.score(df, model, "2012-01-01 00:00:00", "2019-01-01 00:00:00", {"policy_id": "none"}).orderBy("request_id").collect()
    assert none[1].prediction < 0
    assert S.score(df, model, "2012-01-01 00:00:00", "2019-01-01 00:00:00", None).first().warnings == ["policy_missing"]


def test_registry_and_artifacts(spark, tmp_path):
    assert A.write_json(tmp_path / "run_config.json", {"a": 1}) and not A.write_json(tmp_path / "run_config.json", {"a": 1})
    r = S.Registry(tmp_path)
    assert r.manifest() == {"ridge_model": False, "baseline_table": False, "model_metadata": False, "serving_policy": False, "run_config": True}
    with pytest.raises(FileNotFoundError, match="ridge_model"):
        r.model()
    train = spark.createDataFrame([(float(i), "ab"[i % 2], 3.0 * i + i % 2) for i in range(20)], "x double, c string, y double")
    model = ridge.fit(train, "y", ["x"], ["c"], alpha=0.1)
    r.save(model, spark.createDataFrame([(1, 2, 3.5)], "hour int, day_of_week int, baseline_pred double"), P.sign({"policy_id": "none", "final_test_used": False}, "now"), {"n": 20})
    assert r.model() == model and r.policy()["policy_id"] == "none" and r.baseline(spark).first().baseline_pred == 3.5
    again = [x.pred for x in S.Registry(tmp_path).model().predict(train).collect()]
    assert again == [x.pred for x in model.predict(train).collect()]
    with pytest.raises(KeyError):
        r.get("other")
    (tmp_path / "model_metadata.json").write_text("{")
    r.reset()
    assert r.get("model_metadata") is None
    with pytest.raises(ValueError):
        A.write_json(tmp_path / "x.json", {"a": float("nan")})
    df = spark.createDataFrame([(1, 2.345, None)], "n int, x double, s string")
    assert A.json_rows(df).first().json == '{"n":1,"x":2.345,"s":null}'
    assert "| 1 | 2.35 | - |" in A.markdown("T", df) or "| 1 | 2.34 | - |" in A.markdown("T", df)
    digest = A.sha256_of(spark, str(tmp_path / "run_config.json")).first().sha256
    A.verify_sha256(spark, str(tmp_path / "run_config.json"), digest)
    with pytest.raises(ValueError):
        A.verify_sha256(spark, str(tmp_path / "run_config.json"), "0")


def test_raw_source(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("holiday,temp,rain_1h,clouds_all,weather_main,weather_description,date_time,traffic_volume,note\nNone,288.28,0.0,40,Clouds,scattered clouds,2012-10-02 09:00:00,5545,x\n,cold,,40,,,never,5545.0,y\n")
    df, schema = raw.load_raw(spark, str(path))
    a, b = df.collect()
    assert schema == {"missing": ["snow_1h"], "extra": ["note"]}
    assert (a.holiday, a.temp, a.traffic_volume, a.date_time) == ("None", 288.28, 5545, datetime(2012, 10, 2, 9))
    assert (b.holiday, b.temp, b.rain_1h, b.date_time, b.weather_main) == ("", None, None, None, "")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        raw.load_raw(spark, str(tmp_path / "no.csv"))
    raw.write_clean(df.limit(1).withColumn("year", F.year("date_time")), str(tmp_path / "clean"), ["year"])
    assert raw.load_clean(spark, str(tmp_path / "clean")).count() == 1
    raw.write_clean(df.limit(1).union(df.limit(1)), str(tmp_path / "twice"))
    with pytest.raises(ValueError):
        raw.load_clean(spark, str(tmp_path / "twice"))


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.sql("SELECT explode(sequence(TIMESTAMP'2024-01-01 00:00:00', TIMESTAMP'2024-01-03 00:00:00', INTERVAL 7 MINUTE)) AS ts").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.minute("ts").cast("double").alias("value"), F.when(F.minute("ts") % 3 == 0, "a").otherwise("b").alias("label"), (F.hour("ts") % 2).alias("user"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = W.with_event_time(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", "30 minutes")
    W.run_available(W.collapse_windows(stream, "ts", "1 hour", "label", "value"), f"{tmp_path}/out", f"{tmp_path}/log")
    got = {r.start: tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {r.start: tuple(r) for r in W.collapse_windows(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "label", "value").collect()}
    closed = {k: v for k, v in batch.items() if k < max(batch) and k in got}
    assert len(got) >= len(batch) - 2 and all(got[k] == v for k, v in closed.items())
    keyed = W.first_of_key(W.with_event_time(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", "1 hour").select("ts", "label"), ["label"])
    W.run_available(keyed, f"{tmp_path}/out2", f"{tmp_path}/log2")
    assert {r.label for r in spark.read.parquet(f"{tmp_path}/out2").collect()} == {"a", "b"}
    s = W.sessions(W.with_event_time(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", "1 hour"), "ts", "10 minutes", "user", "value")
    W.run_available(s, f"{tmp_path}/out3", f"{tmp_path}/log3")
    assert spark.read.parquet(f"{tmp_path}/out3").count() > 10
