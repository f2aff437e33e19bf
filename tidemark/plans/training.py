"""From a clean table to a stored model and its error tables: tuned on validation, fitted on training rows, frozen, loaded again, and judged once on the test rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import many, ridge, segments, splits
from tidemark.plans import policy as P
from tidemark.plans.baseline import fit_group_mean
from tidemark.plans.experiments import Setup
from tidemark.plans.scoring import Registry
from tidemark.sources import artifacts as A
from tidemark.sources.shared import stored

MODELS = {"ridge": "pred", "baseline": "base"}


def train(s: Setup, df: DataFrame, train_until: str, validation_until: str, folder: str | Path, stamp: str, alphas: tuple[float, ...] = ridge.ALPHAS) -> dict:
    """Tunes and fits, decides the policy on training and validation rows, and stores model, baseline table, metadata and signed policy in the folder. Test rows are not read but for their summary."""
    splits.assert_disjoint(splits.with_split(df, s.time, train_until, validation_until), s.time)
    first, second, _ = splits.time_split(df, s.time, train_until, validation_until)
    features = {"numeric": s.numeric, "categorical": s.categorical, "binary": s.binary}
    found = ridge.moments(first, s.y, **features)
    grid = ridge.scores([found.solve(a) for a in alphas], second, s.y)
    best = min(grid, key=lambda r: round(r[1], 2))[0]
    model = found.solve(best)
    decided = P.decide(model.predict(first), model.predict(second), s.y, "pred")
    overall = first.agg(F.avg(s.y)).first()[0]
    metadata = {"alpha": best, "grid": grid, "train_rows": found.n, "train_until": train_until, "validation_until": validation_until, "mean": overall, "features": features, "n_design_columns": len(found.centre)}
    Registry(folder).save(model, fit_group_mean(first, s.baseline, s.y), P.sign(decided, stamp), A.rounded_values(metadata, 10))
    return metadata


def scored(spark: SparkSession, s: Setup, test: DataFrame, folder: str | Path) -> DataFrame:
    """Test rows with the stored model's prediction, clipped if the frozen policy says so, and the stored baseline's (base)."""
    registry = Registry(folder)
    policy, metadata = registry.policy(), registry.require("model_metadata")
    means = spark.createDataFrame([tuple(r[c] for c in (*s.baseline, "baseline_pred")) for r in registry.require("baseline_table")], ", ".join(f"`{c}` {test.schema[c].dataType.simpleString()}" for c in s.baseline) + ", baseline_pred double")
    out = registry.model().predict(test).join(means, s.baseline, "left").withColumn("base", F.coalesce("baseline_pred", F.lit(metadata["mean"])))
    return out.withColumn("pred", F.greatest(F.lit(0.0), "pred") if policy["policy_id"] == "non_negative_projection" else F.col("pred")).drop("baseline_pred")


def error_tables(s: Setup, rows: DataFrame, by: list[str]) -> DataFrame:
    """(model, segment, value, n, mae, rmse, bias, mean_actual, small_sample): both models over all rows (segment all) and by each column, from one pass over scored rows."""
    long = many.memberships(rows, "_m", [(F.struct(F.lit(m).alias("model"), F.col(c).alias("p")), F.lit(True)) for m, c in MODELS.items()])
    cuts = [(F.struct(F.lit("all").alias("segment"), F.lit("all").alias("value")), F.lit(True))] + [(F.struct(F.lit(c).alias("segment"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("value")), F.lit(True)) for c in by]
    long = many.memberships(long, "_s", cuts).select(F.col("_m.model").alias("model"), "_s.segment", "_s.value", F.col(s.y).alias("_y"), F.col("_m.p").alias("_p"))
    return segments.report(long, ["model", "segment", "value"], "_y", "_p").drop("mean_pred")


def evaluate(spark: SparkSession, s: Setup, df: DataFrame, validation_until: str, folder: str | Path, by: list[str]) -> DataFrame:
    """error_tables() of the test rows under what the folder holds; also written there as JSON and as a Markdown report."""
    tables = stored(error_tables(s, scored(spark, s, df.where(F.col(s.time) >= splits.ntz(validation_until)), folder), by), "errors")
    rows = tables.orderBy("segment", "value", "model").collect()  # a row for each model and segment
    A.write_json(Path(folder) / "evaluation.json", A.rounded_values([r.asDict() for r in rows], 6))
    whole = {r.model: r for r in rows if r.segment == "all"}
    best = min(whole, key=lambda m: whole[m].mae)
    sections: list[tuple[str, str | DataFrame]] = [("Verdict", f"{best} has the lower error over {whole[best].n} rows: " + ", ".join(f"{m} {r.mae:.2f}" for m, r in sorted(whole.items())) + ".")]
    for c in by:
        sections.append((f"Errors by {c}", tables.where(F.col("segment") == c).select("value", "model", "n", "mae", "rmse", "bias").orderBy("value", "model")))
        worst = [max((r for r in rows if r.segment == c and r.model == m and not r.small_sample), key=lambda r: r.mae, default=None) for m in sorted(MODELS)]
        sections.append((f"Hardest {c}", "; ".join(f"{r.model}: {r.value} ({r.mae:.2f})" for r in worst if r) or "every sample is small"))
    (Path(folder) / "evaluation.md").write_text(A.report("Evaluation", sections))
    return tables
