"""Training and evaluation as one entry."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans import policy as P
from tidemark.plans import training as T
from tidemark.plans.experiments import Setup


def test_train_then_evaluate(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(24 * 90):
        t = datetime(2020, 1, 1) + timedelta(hours=i)
        x = rng.gauss(10, 2) if rng.random() > 0.1 else None
        rows.append((t, x, t.hour, t.weekday(), max(0.0, 4 * ((x or 10) - 10) + (30 if 7 <= t.hour <= 18 else -5) + rng.gauss(0, 2))))
    df = spark.createDataFrame(rows, "t timestamp_ntz, x double, hour int, day_of_week int, y double")
    s = Setup("t", "y", ["t"], "2030-01-01", ["x"], ["hour"])
    meta = T.train(s, df, "2020-02-20 00:00:00", "2020-03-10 00:00:00", tmp_path, "then")
    assert meta["train_rows"] == df.where("t < timestamp_ntz'2020-02-20 00:00:00'").count() and meta["n_design_columns"] == 25
    policy = json.loads((tmp_path / "serving_policy.json").read_text())
    assert P.is_intact(policy) and policy["policy_id"] == "non_negative_projection" and not policy["final_test_used"]
    out = {(r.model, r.segment, r.value): r for r in T.evaluate(spark, s, df, "2020-03-10 00:00:00", tmp_path, ["hour"]).collect()}
    test = T.scored(spark, s, df.where("t >= timestamp_ntz'2020-03-10 00:00:00'"), tmp_path)
    assert test.where("pred < 0").count() == 0
    for name, column in T.MODELS.items():
        by = {r.hour: r.m for r in test.groupBy("hour").agg(F.avg(F.abs(F.col("y") - F.col(column))).alias("m")).collect()}
        assert all(out[name, "hour", str(h)].mae == pytest.approx(m) for h, m in by.items()) and out[name, "all", "all"].n == test.count()
    assert out["ridge", "all", "all"].mae < out["baseline", "all", "all"].mae
    text = (tmp_path / "evaluation.md").read_text()
    assert "# Evaluation" in text and "ridge has the lower error" in text and "Hardest hour" in text
    assert len(json.loads((tmp_path / "evaluation.json").read_text())) == 2 * 25
    (tmp_path / "serving_policy.json").write_text(json.dumps(policy | {"policy_id": "none"}))
    with pytest.raises(RuntimeError):
        T.scored(spark, s, df, tmp_path)
    with pytest.raises(AssertionError):
        T.train(s, df, "2020-03-10 00:00:00", "2020-03-10 00:00:00", tmp_path, "then")
