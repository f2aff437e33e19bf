"""Late rows correct windows; a batch that runs again changes nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import corrections as C
from tidemark.streaming import windows as W

SCHEMA = "ts timestamp_ntz, label string, value double"


def rows_of(rng, n, hours):
    return [(datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60 * hours)), rng.choice(["a", "b", "c", None]), float(rng.randrange(50)) if rng.random() > 0.1 else None) for _ in range(n)]


def table(df):
    return sorted(((r.start, r.n, r.median, r.total, r.label_mode, r.label_set) for r in df.collect()), key=str)


def test_late_rows_and_replayed_batches(spark, tmp_path):
    rng = random.Random(8)
    parts = [rows_of(rng, 120, 12), rows_of(rng, 60, 20), [(datetime(2024, 1, 1, 0, 5), "c", 1000.0), (datetime(2024, 1, 1, 0, 6), "c", 7.0), (None, "a", 1.0)]]  # the last part is late: it corrects the first window
    source, sink, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    done = []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        done += part
        stream = C.corrected_windows(spark.readStream.schema(SCHEMA).parquet(source), "ts", "2 days", "1 hour", "label", "value")
        C.run_corrections(stream, sink, log)
        batch = W.collapse_windows(spark.createDataFrame(done, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null"), "ts", "1 hour", "label", "value")
        want = [(s, n, m, t, mode, labels) for s, n, m, t, mode, labels in table(batch.select("start", "n", "median", "total", "label_mode", "label_set"))]
        assert table(C.current(spark, sink)) == want
    before = table(C.current(spark, sink))
    batches = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("batch=*"))
    last = spark.read.parquet(f"{sink}/batch={batches[-1]}").toPandas()
    assert 0 < len(last) < len(before)  # only what changed was emitted again
    for k in batches:  # each batch once more, in order and then the first again
        again = spark.createDataFrame(spark.read.parquet(f"{sink}/batch={k}").toPandas(), spark.read.parquet(f"{sink}/batch={k}").schema)
        C.merge(again, k, sink)
    assert table(C.current(spark, sink)) == before


def test_rows_beyond_the_delay_are_dropped(spark, tmp_path):
    source, sink, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    parts = [[(datetime(2024, 1, 1, 0, 5), "a", 1.0)], [(datetime(2024, 1, 3), "a", 2.0)], [(datetime(2024, 1, 3, 0, 1), "a", 3.0)], [(datetime(2024, 1, 1, 0, 6), "a", 9.0), (datetime(2024, 1, 2, 23, 30), "b", 4.0)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        C.run_corrections(C.corrected_windows(spark.readStream.schema(SCHEMA).parquet(source), "ts", "1 hour", "1 hour", "label", "value"), sink, log)
    got = {r.start: (r.n, r.total) for r in C.current(spark, sink).collect()}
    assert got == {datetime(2024, 1, 1): (1, 1.0), datetime(2024, 1, 3): (2, 5.0), datetime(2024, 1, 2, 23): (1, 4.0)}


@pytest.mark.parametrize(("values", "counts", "want"), [([], [], None), ([3.0], [1], 3.0), ([1.0, 2.0], [1, 1], 1.5), ([1.0, 2.0, 9.0], [2, 1, 2], 2.0), ([1.0, 5.0], [2, 2], 3.0)])
def test_medians_of_counts(values, counts, want):
    assert C._median(values, counts) == want
