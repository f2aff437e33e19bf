"""Drift: population stability index against the deciles of a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import quantiles

FLOOR = 1e-6


def psi(df: DataFrame, value: str, group: str, reference: object, bins: int = 10, exact: bool = True) -> DataFrame:
    """(group, psi, verdict) of every group but the reference, over the reference's quantile bins.

    Only distinct inner quantiles are edges, the outer bins being open, and every bin counts, if empty with a floor. Shares
    are floored but not scaled again. Edges are exact, found by digits where the reference is large; exact=False takes a sketch.
    """
    inner = [i / bins for i in range(1, bins)]
    base = df.where(F.col(group) == reference)
    outer = base.agg(F.count(value).alias("n"), F.min(value).alias("a"), F.max(value).alias("b"), *([] if exact else [F.percentile_approx(value, inner, 100_000).alias("q")])).first()
    found = quantiles.exact_quantiles(base, value, inner, outer.n) if exact else outer.q or []
    inside = sorted({float(q) for q in found if q is not None and outer.a < q < outer.b})
    edges = df.sparkSession.createDataFrame([(inside,)], "edges array<double>")
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(value))))
    counts = rows.groupBy(group, "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    grid = totals.join(F.broadcast(edges)).select(group, "total", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    shares = grid.join(counts, [group, "bin"], "left").select(group, "bin", F.greatest(F.coalesce("n", F.lit(0)) / F.col("total"), F.lit(FLOOR)).alias("share"))
    base = shares.where(F.col(group) == reference).select("bin", F.col("share").alias("base"))
    part = (F.col("share") - F.col("base")) * F.ln(F.col("share") / F.col("base"))
    out = shares.where(F.col(group) != reference).join(base, "bin").groupBy(group).agg(F.sum(part).alias("psi"))
    return out.withColumn("verdict", F.when(F.col("psi") < 0.10, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("shifted"))


def trend(first: float, last: float, band: float = 0.10) -> str:
    """Verdict on a series of errors: worse, better, or flat within the band."""
    if first <= 0:
        return "flat"
    change = last / first - 1
    return "worse" if change > band else "better" if change < -band else "flat"
