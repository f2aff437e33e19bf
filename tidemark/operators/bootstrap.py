"""Paired block bootstrap of the difference between two models' errors, for one window or many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_sums(df: DataFrame, block: str, y: str, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Sums per block, numbered from 0 in the order of blocks (of each group); all that the draws need of the rows."""
    ea, eb = F.col(y) - F.col(a), F.col(y) - F.col(b)
    sums = df.groupBy(*by, F.col(block).alias("block")).agg(F.count("*").alias("n"), F.sum(F.abs(ea)).alias("abs_a"), F.sum(F.abs(eb)).alias("abs_b"), F.sum(ea * ea).alias("sq_a"), F.sum(eb * eb).alias("sq_b"))
    return sums.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("block")) - 1)


def _pick(seed: Column) -> Column:
    digest = F.md5(F.concat_ws("-", seed, F.col("draw"), F.col("pick")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.col("blocks")).cast("int")


def _differences(picks: DataFrame, by: list[str]) -> DataFrame:
    total = picks.groupBy(*by, "draw").agg(*(F.sum(c).alias(c) for c in ("n", "abs_a", "abs_b", "sq_a", "sq_b")))
    return total.select(*by, "draw", ((F.col("abs_b") - F.col("abs_a")) / F.col("n")).alias("d_mae"), (F.sqrt(F.col("sq_b") / F.col("n")) - F.sqrt(F.col("sq_a") / F.col("n"))).alias("d_rmse"))


def draws(sums: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """(draw, d_mae, d_rmse) as b - a, positive where a is better: each draw picks as many blocks as there are, by md5 of seed, draw and pick.

    Blocks are calendar units, so their sums are few; the picks (draws x blocks) meet them by number and are summed by draw.
    Both models get the same picks.
    """
    n = sums.agg(F.count("*").alias("blocks"))
    picks = sums.sparkSession.range(n_draws).withColumnRenamed("id", "draw").join(F.broadcast(n)).select("draw", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("pick"))
    return _differences(picks.withColumn("nth", _pick(F.lit(str(seed)))).join(sums, "nth"), [])


def draws_by(sums: DataFrame, n_draws: int, by: str, seeds: dict) -> DataFrame:
    """draws() of every group of block sums, each with its own seed: (by, draw, d_mae, d_rmse). Draws are dealt out before their picks are made, so that groups share all tasks."""
    seed = F.lit(None).cast("string")
    for k, v in seeds.items():
        seed = F.when(F.col(by) == k, str(v)).otherwise(seed)
    n = sums.groupBy(by).agg(F.count("*").alias("blocks")).withColumn("seed", seed)
    each = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw")).repartition(by, "draw")
    picks = each.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("pick"))
    return _differences(picks.withColumn("nth", _pick(F.col("seed"))).join(sums, [by, "nth"]), [by])


def interval(sampled: DataFrame, column: str, level: float = 0.95, by: list[str] = ()) -> DataFrame:
    """Percentile interval, population standard deviation, share above zero, and whether zero lies outside."""
    low, high = (1 - level) / 2, (1 + level) / 2
    lo, hi = F.percentile(column, F.lit(low)), F.percentile(column, F.lit(high))
    return sampled.groupBy(*by).agg(
        F.count(column).alias("n_draws"), (lo).alias("ci_low"), (hi).alias("ci_high"), F.stddev_pop(column).alias("sd"),
        (100.0 * F.avg((F.col(column) > 0).cast("double"))).alias("better_pct"), ((lo > 0) | (hi < 0)).alias("excludes_zero"),
    )
