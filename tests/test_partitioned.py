"""Rewrites of partitioned tables."""

from pathlib import Path

from pyspark.sql import functions as F

from tidemark.sources import partitioned as P


def files(at):
    return {f: f.stat().st_mtime_ns for f in Path(at).rglob("*.parquet") if P.MANIFEST not in str(f)}


def rows(spark, at):
    return sorted(((r.month, r.v, r.s) for r in spark.read.parquet(at).collect()), key=str)


def test_only_what_changed_is_touched(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.createDataFrame([(f"2020-0{1 + i % 3}", i, None if i % 5 == 0 else f"x{i}") for i in range(60)] + [("2020-01", 1, "x1")] * 3, "month string, v long, s string")
    assert [k for k, _ in P.write_changed(df, at, ["month"])] == ["written"] * 3
    first = files(at)
    assert P.write_changed(df.orderBy(F.desc("v")).repartition(5), at, ["month"]) == [] and files(at) == first  # order and tasks do not matter
    changed = df.withColumn("v", F.when(F.col("month") == "2020-02", F.col("v") + 1).otherwise(F.col("v")))
    assert P.write_changed(changed, at, ["month"]) == [("written", ("2020-02",))]
    second = files(at)
    assert {f for f in first if first[f] == second.get(f)} == {f for f in first if "2020-02" not in str(f)}
    assert rows(spark, at) == sorted(((r.month, r.v, r.s) for r in changed.collect()), key=str)
    fewer = changed.where("month <> '2020-01'").unionByName(spark.createDataFrame([("2021-01", 5, "new")], "month string, v long, s string"))
    assert P.write_changed(fewer, at, ["month"]) == [("removed", ("2020-01",)), ("written", ("2021-01",))]
    assert rows(spark, at) == sorted(((r.month, r.v, r.s) for r in fewer.collect()), key=str)


def test_signatures_tell_rows_apart(spark):
    sig = lambda rows: P.signatures(spark.createDataFrame(rows, "k long, a string, b string"), ["k"]).first().signature
    assert sig([(1, "x", "y"), (1, "z", None)]) == sig([(1, "z", None), (1, "x", "y")])
    assert len({sig(r) for r in ([(1, "x", "y")], [(1, "xy", "")], [(1, "x", None)], [(1, None, "x")], [(1, "x", "")], [(1, "x|1:y", "")], [(1, "x", "y")] * 2)}) == 7


def test_a_write_that_failed_before_its_manifest_is_made_good(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "month string, v long")
    P.write_changed(df, at, ["month"])
    df.withColumn("v", F.lit(9).cast("long")).write.mode("overwrite").parquet(f"{at}/{P.MANIFEST}/v7")
    Path(f"{at}/{P.MANIFEST}/v7/_SUCCESS").unlink()
    assert P.write_changed(df, at, ["month"]) == []  # a manifest without its end does not count
    later = df.withColumn("v", F.col("v") + 1)
    assert len(P.write_changed(later, at, ["month"])) == 2 and sorted(r.v for r in spark.read.parquet(at).collect()) == [2, 3]
