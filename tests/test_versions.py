"""Policies and models over time."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ridge
from tidemark.plans import policy as P
from tidemark.plans import versions as V

DOCS = [
    {"policy_id": "none", "n": 1, "evidence": {"mae": 2.0, "rows": 3, "deep": [1.5, {"x": True}]}, "list": [], "empty": {}, "null": None, "text": "a.b"},
    {"policy_id": "none", "n": True, "evidence": {"mae": 2.4, "rows": 3, "deep": [1.0, {"x": 1}]}, "list": [1], "empty": {}, "text": "a.b"},
    {"policy_id": "x", "n": 1.5, "evidence": {"mae": 2.6, "rows": 4, "deep": [1.5]}, "list": [], "null": None, "text": "1"},
    {"evidence": 5, "n": 1},
    {},
]


def test_differences_as_rows_are_those_of_the_driver(spark):
    pairs = [(i, j) for i in range(len(DOCS)) for j in range(len(DOCS))]
    first = V.flattened(spark.createDataFrame([(i, j, json.dumps(DOCS[i])) for i, j in pairs], "i long, j long, doc string"), ["i", "j"], "doc")
    second = V.flattened(spark.createDataFrame([(i, j, json.dumps(DOCS[j])) for i, j in pairs], "i long, j long, doc string"), ["i", "j"], "doc")
    got = {}
    for r in V.differences(first, second, ["i", "j"]).collect():
        got.setdefault((r.i, r.j), set()).add((r.path, r.difference))
    for i, j in pairs:
        want = set()
        for d in P.differences(DOCS[i], DOCS[j]):
            path, what = d.split(": ", 1)
            want.add((path, {"only in the first": "only first", "only in the second": "only second"}.get(what, "differs")))
        assert got.get((i, j), set()) == want, (i, j)


def test_requests_meet_what_was_frozen_at_their_time(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 2.0 * i - 5) for i in range(20)], "x double, y double")
    registry = V.VersionedRegistry(spark, str(tmp_path / "registry"))
    for v, (at, alpha, policy) in enumerate([("2020-01-01 00:00:00", 0.001, "none"), ("2020-02-01 00:00:00", 1000.0, "non_negative_projection")]):
        registry.freeze(v, at, ridge.fit(df, "y", ["x"], alpha=alpha), {"policy_id": policy, "final_test_used": False})
    registry.freeze(1, "2019-01-01 00:00:00", ridge.fit(df, "y", ["x"], alpha=5.0), {"policy_id": "none"})  # a version is never written again
    times = [datetime(2019, 12, 31), datetime(2020, 1, 1), datetime(2020, 1, 31, 23, 59), datetime(2020, 2, 1), None]
    requests = spark.createDataFrame([(i, t, -900.0) for i, t in enumerate(times)], "i int, t timestamp_ntz, x double")
    out = registry.score(requests, "t").orderBy("i").collect()
    assert [r.version for r in out] == [None, 0, 0, 1, None] and [r.clipped for r in out][1:4] == [False, False, True]
    assert out[1].prediction == out[1].raw < 0 and out[3].prediction == 0 > out[3].raw and out[0].prediction is None
    bad = P.sign({"policy_id": "none"}, "now") | {"policy_id": "non_negative_projection"}
    spark.createDataFrame([(7, "2021-01-01 00:00:00", json.dumps(ridge.fit(df, "y", ["x"]).to_dict()), json.dumps(bad))], V.VersionedRegistry.SCHEMA).write.parquet(str(tmp_path / "registry" / "v=7"))
    with pytest.raises(RuntimeError, match=r"\[7\]"):
        registry.score(requests, "t")


def test_documents_that_refuse(spark):
    text = json.dumps({"final_test_used": False})
    used = json.dumps({"final_test_used": True})
    docs = spark.createDataFrame([(1, text, text), (2, text, text + " "), (3, used, used), (4, None, text), (5, "no json", "no json")], "i int, content string, signed string")
    out = V.refusals(docs.withColumn("signature", F.sha2("signed", 256)), "content", "signature").orderBy("i")
    assert [r.refused for r in out.collect()] == [None, "changed since", "final test used", "nothing is frozen", None]
