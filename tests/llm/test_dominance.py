import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import dominance as d


def brute(rows):
    """rows (slot, level, weight) -> (n, sum of weights) above each, or nulls."""
    out = []
    for s, v, _ in rows:
        if s is None or v is None:
            out.append((None, None))
            continue
        up = [w for a, b, w in rows if a is not None and b is not None and a <= s and b > v]
        out.append((len(up), sum(up)))
    return out


def count(spark, rows, shard_rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, slot long, level long, w long")
    got = d.count_above(df, F.col("slot"), F.col("level"), F.col("w"), shard_rows).collect()
    assert len(got) == len(rows)
    return [(r.n_above, r.rows_above) for r in sorted(got, key=lambda r: r.id)]


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, q = int(rng.integers(0, 200)), int(rng.integers(0, 200))
    version, level = rng.integers(-5, 5 + seed * 20, n), rng.integers(-3, 3 + seed * 50, n)
    weights = rng.integers(0, 9, (n, 2))
    at, above = rng.integers(-8, 120, q), rng.integers(-8, 300, q)
    want = np.array([weights[(version <= a) & (level > b)].sum(axis=0) for a, b in zip(at, above)]).reshape(q, 2)
    assert (d.suffix_sums(version, level, weights, at, above) == want).all()


@pytest.mark.parametrize("shard_rows", [3, 7, 40, 50_000])
def test_counts_equal_brute_force_whatever_the_shards(spark, shard_rows):
    rng = random.Random(shard_rows)
    rows = [(rng.randrange(40) if rng.random() > 0.05 else None, rng.randrange(25) if rng.random() > 0.05 else None, 1 + rng.randrange(2)) for _ in range(300)]
    assert count(spark, rows, shard_rows) == brute(rows)


@pytest.mark.parametrize("kind", ["one point many times", "one slot", "one level", "rising", "falling"])
def test_hot_slots_levels_and_equal_rows_are_cut_apart(spark, kind):
    rng = random.Random(kind)
    make = {"one point many times": lambda i: (5, 5), "one slot": lambda i: (5, rng.randrange(90)), "one level": lambda i: (rng.randrange(90), 5), "rising": lambda i: (i, i), "falling": lambda i: (i, -i)}[kind]
    rows = [(*make(i), 1) for i in range(120)] + [(rng.randrange(90), rng.randrange(90), 2) for _ in range(60)]
    assert count(spark, rows, 10) == brute(rows)


def test_no_task_gets_more_than_a_range(spark):
    sizes = []
    rows = spark.range(3000).select((F.col("id") * 0).alias("slot"), (F.col("id") * 0).alias("level"), F.lit(1).alias("w"), F.monotonically_increasing_id().alias("tie"))
    parts = rows.repartitionByRange(30, "slot", F.desc("level"), "tie").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    sizes = [r["count"] for r in parts]
    assert max(sizes) < 400


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "id long, slot long, level long, w long")
    assert d.count_above(empty, F.col("slot"), F.col("level"), F.col("w")).collect() == []
    df = spark.createDataFrame([(1, 2, 1, "x", 0), (1, 1, 1, "y", 0)], "slot long, level long, tie long, shard string, n_above int")
    got = {r.shard: (r.tie, r.n_above) for r in d.count_above(df.withColumnRenamed("tie", "band"), F.col("slot"), F.col("level"), F.lit(1)).withColumnRenamed("band", "tie").collect()}
    assert got == {"x": (1, 0), "y": (1, 1)}


def test_slots_are_utc_in_any_zone_and_levels_are_doubles(spark):
    base = datetime(1970, 1, 1)
    times = [base + timedelta(hours=h, seconds=s, microseconds=u) for h, s, u in [(0, 0, 0), (0, 3599, 999999), (-1, 0, 0), (-1, 3599, 5), (474_000, 1, 0), (474_337, 3599, 0)]]
    was = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "at timestamp_ntz, i int")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r.s for r in df.select("i", d.hour_slot(F.col("at"), df.schema["at"].dataType).alias("s")).orderBy("i").collect()]
            assert got == [0, 0, -1, -1, 474_000, 474_337]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    stamps = df.select("i", F.col("at").cast("timestamp").alias("at"))
    assert [r.s for r in stamps.select("i", d.hour_slot(F.col("at"), stamps.schema["at"].dataType).alias("s")).orderBy("i").collect()] == [0, 0, -1, -1, 474_000, 474_337]
    totals = spark.createDataFrame([(4.999,), (4.99,), (4.995,), (0.0,), (-0.006,), (float("nan"),), (float("inf"),), (None,)], "t double")
    assert [r.v for r in totals.select(d.level_of(F.col("t")).alias("v")).collect()] == [5, 4, 5, 0, -1, None, None, None]
