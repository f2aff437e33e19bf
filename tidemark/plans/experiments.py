"""Experiments on development rows: each composes the operators and refuses rows of the final test.

A Setup names the columns, so the same experiment runs on any series. Models are small: the driver solves them from sums that one pass takes for all
seeds, arms and windows of an experiment, and one more pass scores them all. Results are plain dictionaries of aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, drift, explore, lags, many, ridge, segments, splits
from tidemark.operators.segments import metrics
from tidemark.plans.baseline import fit_group_mean, predict_group_mean
from tidemark.sources.shared import stored

#: Fixed values.
SEEDS = (11, 23, 37, 53, 71)
LAG_HOURS = (1, 24, 168)
DRAWS, DRAW_SEED = 4000, 20240501


@dataclass
class Setup:
    """Columns of a series: its time, target, unique keys (for hash orders), features, and the cut of the final test."""

    time: str
    y: str
    keys: list[str]
    final_test: str
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    baseline: list[str] = field(default_factory=lambda: ["hour", "day_of_week"])
    alpha: float = 0.001

    def guard(self, df: DataFrame, where: str) -> DataFrame:
        return splits.assert_no_final_test(df, self.time, self.final_test, where)

    def fit(self, train: DataFrame, alpha: float | None = None, **other) -> ridge.Ridge:
        self.guard(train, "training rows")
        how = {"numeric": self.numeric, "categorical": self.categorical, "binary": self.binary} | other
        return ridge.fit(train, self.y, alpha=self.alpha if alpha is None else alpha, **how)

    def columns(self) -> list[str]:
        """Those that models and tests read."""
        return list(dict.fromkeys([self.time, self.y, *self.keys, *self.numeric, *self.categorical, *self.binary]))

    def fit_many(self, rows: DataFrame, by: str, **other) -> tuple[dict, dict]:
        self.guard(rows, "training rows")
        return many.fit_many(rows, self.y, by, **({"numeric": self.numeric, "categorical": self.categorical, "binary": self.binary, "alpha": self.alpha} | other))

    def score_many(self, rows: DataFrame, models: dict) -> dict[str, dict[str, float]]:
        """Metrics of each _test, its rows scored by the model that _model names."""
        found = many.metrics_by(many.predicted(rows, "_model", models), ["_test"], self.y).collect()
        return {r["_test"]: {k: r[k] for k in ("n", "mae", "rmse", "r2")} for r in found}

    def score(self, model: ridge.Ridge, df: DataFrame) -> dict[str, float]:
        return metrics(model.predict(df), self.y).first().asDict()

    def before(self, df: DataFrame, cut: str) -> DataFrame:
        return df.where(F.col(self.time) < splits.ntz(cut))

    def since(self, df: DataFrame, cut: str) -> DataFrame:
        return df.where(F.col(self.time) >= splits.ntz(cut))

    def both(self, train: DataFrame, test: DataFrame, model: ridge.Ridge | None = None) -> DataFrame:
        """Test rows with the ridge's prediction (pred) and the baseline's (base)."""
        scored = (model or self.fit(train)).predict(test)
        out = predict_group_mean(scored.withColumnRenamed("pred", "_ridge"), fit_group_mean(train, self.baseline, self.y), train, self.baseline, self.y)
        return out.withColumnRenamed("pred", "base").withColumnRenamed("_ridge", "pred")


def _summary(values: list[float]) -> dict[str, float]:
    n, mean = len(values), sum(values) / len(values)
    return {"mean": mean, "sd": (sum((v - mean) ** 2 for v in values) / n) ** 0.5, "least": min(values), "greatest": max(values), "n": n}


def random_vs_time(s: Setup, dev: DataFrame, cut: str, seeds=SEEDS) -> dict:
    """How much better a random split looks: on its own test rows, and, fairly, against the time model on those rows.

    Rows are dealt once for all seeds; one pass gives the sums of every model, one more the errors on every test.
    """
    s.guard(dev, "random_vs_time")
    dealt = splits.hash_ranks(dev, s.keys, tuple(seeds)).withColumn("_split", splits.split_of_rank())
    dealt = stored(dealt.select(*s.columns(), "seed", "_split"), "dealt")
    seed, once, t = F.col("seed").cast("string"), F.col("seed") == seeds[0], F.col(s.time)
    models, _ = s.fit_many(many.memberships(dealt, "_model", [(seed, F.col("_split") == "train"), (F.lit("time"), once & (t < splits.ntz(cut)))]), "_model")
    on_test = F.col("_split") == "test"
    tests = [(F.struct(seed.alias("_test"), seed.alias("_model")), on_test), (F.struct(F.concat(F.lit("same"), seed).alias("_test"), F.lit("time").alias("_model")), on_test), (F.struct(F.lit("time").alias("_test"), F.lit("time").alias("_model")), once & (t >= splits.ntz(cut)))]
    found = s.score_many(many.memberships(dealt, "_t", tests).select("*", "_t._test", "_t._model"), models)
    time, per_seed = found["time"], []
    for k in seeds:
        own, same = found[str(k)], found[f"same{k}"]
        per_seed.append({"seed": k, "random": own, "time_on_same_rows": same, "own_rows": own["mae"] - time["mae"], "same_rows": own["mae"] - same["mae"]})
    return {"time": time, "per_seed": per_seed, "own_rows": _summary([r["own_rows"] for r in per_seed]), "same_rows": _summary([r["same_rows"] for r in per_seed])}


def training_arms(s: Setup, dev: DataFrame, older: str, year_start: str, seeds=SEEDS) -> dict:
    """What the distance in time and the number of training rows each do: four arms, one test (a random half of the last year).

    A: rows before `older`. B: all rows before the last year. C: B and the other half of the last year. D: as many rows as B
    has, drawn from C. All arms of all seeds are fitted from one set of sums and scored in one pass.
    """
    s.guard(dev, "training_arms")
    t = F.col(s.time)
    halves = splits.hash_ranks(dev.withColumn("_last", t >= splits.ntz(year_start)), s.keys, tuple(seeds), ["_last"])
    is_test = F.col("_last") & (F.col("_rank") > F.floor(F.col("_total") * 0.5))
    halves = stored(halves.select(*s.columns(), "seed", "_last", is_test.alias("_is_test")), "halves")
    n_b = halves.where(~F.col("_last") & (F.col("seed") == seeds[0])).count()
    dealt = stored(splits.hash_ranks(halves, s.keys, parts=["_is_test"]).drop("_total"), "dealt")
    seed, once, in_c = F.col("seed").cast("string"), F.col("seed") == seeds[0], ~F.col("_is_test")
    arms = [(F.lit("A"), once & (t < splits.ntz(older))), (F.lit("B"), once & ~F.col("_last")), (F.concat(F.lit("C"), seed), in_c), (F.concat(F.lit("D"), seed), in_c & (F.col("_rank") <= n_b))]
    models, rows = s.fit_many(many.memberships(dealt, "_model", arms), "_model")
    name = lambda arm: F.lit(arm) if arm in "AB" else F.concat(F.lit(arm), seed)
    tests = [(F.struct(F.concat(F.lit(arm), seed).alias("_test"), name(arm).alias("_model")), F.col("_is_test")) for arm in "ABCD"]
    found = s.score_many(many.memberships(dealt, "_t", tests).select("*", "_t._test", "_t._model"), models)
    mae = {arm: [found[f"{arm}{k}"]["mae"] for k in seeds] for arm in "ABCD"}
    counts = {arm: sorted(n for k, n in rows.items() if k[0] == arm) for arm in "ABCD"}
    delta = lambda a, b: _summary([x - y for x, y in zip(mae[a], mae[b], strict=True)])
    out = {k: _summary(v) | {"median_rows": counts[k][len(counts[k]) // 2]} for k, v in mae.items()}
    return out | {"C_minus_A": delta("C", "A"), "C_minus_B": delta("C", "B"), "D_minus_B": delta("D", "B")}


def alternate_months(s: Setup, dev: DataFrame, year_start: str) -> dict:
    """The last year's odd months, predicted from the years before (P1) and from these with its even months (P2)."""
    s.guard(dev, "alternate_months")
    past, last = s.before(dev, year_start), s.since(dev, year_start)
    odd = F.month(s.time) % 2 == 1
    test = last.where(odd)
    return {"P1": s.score(s.fit(past), test), "P2": s.score(s.fit(past.unionByName(last.where(~odd))), test)}


def windows(s: Setup, dev: DataFrame, cuts: list[str], until: list[str]) -> DataFrame:
    """Rows of every window's test with fold, pred (ridge) and base (group mean), both of the rows before its cut: models come from sums by month, rows are scored in one pass."""
    s.guard(dev, "windows")
    models = many.fit_expanding(dev, s.time, cuts, s.y, s.numeric, s.categorical, s.binary, s.alpha)
    return stored(many.score_windows(dev, s.time, cuts, until, models, s.y, s.baseline), "windows")


def rolling_origin(s: Setup, dev: DataFrame, cuts: list[str], until: list[str]) -> dict:
    """Train before each cut, test up to its end; the pooled errors by month and season, and the trend over folds."""
    pooled = windows(s, dev, cuts, until).withColumn("month", F.month(s.time)).withColumn("season", segments.season_of(F.month(s.time)))
    folds = [{k: v for k, v in r.asDict().items() if k != "fold"} for r in many.metrics_by(pooled, ["fold"], s.y).orderBy("fold").collect()]
    rows = lambda by: [r.asDict() for r in segments.report(pooled, [by], s.y).orderBy(by).collect()]
    return {"folds": folds, "by_month": rows("month"), "by_season": rows("season"), "trend": drift.trend(folds[0]["mae"], folds[-1]["mae"])}


def covariate_drift(s: Setup, dev: DataFrame, columns: list[str], reference_year: int) -> dict:
    s.guard(dev, "covariate_drift")
    df = dev.withColumn("year", F.year(s.time))
    return {
        "target": [r.asDict() for r in explore.yearly_stats(dev, s.time, s.y).orderBy("year").collect()],
        "psi": {c: {r.year: r.psi for r in drift.psi(df, c, "year", reference_year).collect()} for c in columns},
    }


def night_hours(s: Setup, dev: DataFrame, cuts: list[str], until: list[str]) -> list[dict]:
    """Where the ridge loses to the baseline, per fold: by hour, and for night and day."""
    scored = windows(s, dev, cuts, until).withColumn("_hour", F.hour(s.time))
    hours = segments.compare_by(scored, ["fold", "_hour"], s.y, "pred", "base").orderBy("fold", "_hour").collect()
    parts = segments.night_rollup(scored, "_hour", s.y, "pred", "base", by=["fold"]).collect()
    out = []
    for i in range(len(cuts)):
        by_hour = [r.asDict() for r in hours if r.fold == i]
        out.append({"by_hour": by_hour, "parts": {r.part: r.asDict() for r in parts if r.fold == i}, "n_worse": sum(r["a_worse"] for r in by_hour)})
    return out


def log_target(s: Setup, dev: DataFrame, cut: str) -> dict:
    """The target as it is against log1p of it, predictions taken back by expm1."""
    s.guard(dev, "log_target")
    train, test = s.before(dev, cut), s.since(dev, cut)
    model = ridge.fit(train.withColumn("_log", F.log1p(s.y)), "_log", s.numeric, s.categorical, s.binary, s.alpha)
    back = model.predict(test).withColumn("pred", F.expm1("pred"))
    return {"linear": s.score(s.fit(train), test), "log": metrics(back, s.y).first().asDict()}


def alpha_sensitivity(s: Setup, train: DataFrame, validation: DataFrame, alphas=ridge.WIDE_ALPHAS) -> dict:
    s.guard(train, "alpha_sensitivity")
    s.guard(validation, "alpha_sensitivity")
    best, rows = ridge.tune(train, validation, s.y, alphas, numeric=s.numeric, categorical=s.categorical, binary=s.binary)
    return {"best": best, "rows": rows} | ridge.sensitivity(rows, best)


def test_window_bias(s: Setup, train: DataFrame, validation: DataFrame, last_month: int = 9) -> dict:
    """What a test that stops after a year's first months says of the whole year; the three worst months."""
    s.guard(validation, "test_window_bias")
    scored = s.fit(train).predict(validation).withColumn("month", F.month(s.time))
    worst = segments.report(scored, ["month"], s.y).orderBy(F.col("mae").desc(), "month").limit(3)
    return segments.window_bias(scored, "month", s.y, "pred", last_month).first().asDict() | {"worst": [r.month for r in worst.collect()]}


test_window_bias.__test__ = False  # a name that pytest would collect


def lag_leak(s: Setup, dev: DataFrame, cut: str, hours=LAG_HOURS, seeds=SEEDS, by: list[str] = ()) -> dict:
    """Time and random splits without lags, with lags by time, and with lags by row; rows with all lags only.

    The three arms are one long frame (without lags their columns are zero, which weigh nothing); its rows are dealt once for all seeds, and all models come from one set of sums.
    """
    s.guard(dev, "lag_leak")
    features = [f"_f{i}" for i in range(len(hours))]
    arms = {"none": (dev, None), "time": (lags.lag_by_time(dev, s.time, s.y, list(hours), by), [f"lag_{h}h" for h in hours]), "row": (lags.lag_by_row(dev, s.time, s.y, list(hours), by), [f"shift_{h}" for h in hours])}
    frames = []
    for name, (df, columns) in arms.items():
        df = splits.complete_rows(df, columns)[0] if columns else df
        frames.append(df.select(*s.columns(), F.lit(name).alias("_arm"), *((F.col(columns[i]).cast("double") if columns else F.lit(0.0)).alias(f) for i, f in enumerate(features))))
    dealt = splits.hash_ranks(reduce(DataFrame.unionByName, frames), s.keys, tuple(seeds), ["_arm"]).withColumn("_split", splits.split_of_rank())
    dealt = stored(dealt.drop("_rank", "_total"), "dealt")
    t, once, own, by_time = F.col(s.time), F.col("seed") == seeds[0], F.concat("_arm", F.col("seed").cast("string")), F.concat("_arm", F.lit("time"))
    rows = many.memberships(dealt, "_model", [(own, F.col("_split") == "train"), (by_time, once & (t < splits.ntz(cut)))])
    models, _ = s.fit_many(rows, "_model", numeric=[*s.numeric, *features])
    tests = many.memberships(dealt, "_model", [(own, F.col("_split") == "test"), (by_time, once & (t >= splits.ntz(cut)))])
    found = s.score_many(tests.withColumn("_test", F.col("_model")), models)
    return {name: {"time": found[f"{name}time"], "optimism": _summary([found[f"{name}{k}"]["mae"] - found[f"{name}time"]["mae"] for k in seeds])} for name in arms}


def audit_windows(s: Setup, scored: DataFrame, seeds: dict[int, int], n_draws: int = DRAWS) -> dict[int, dict]:
    """For every fold of scored (fold, pred, base): bootstrap by day with the fold's seed, months won and night hours, all folds at once."""
    days = scored.withColumn("_day", F.to_date(s.time)).withColumn("_hour", F.hour(s.time)).withColumn("_month", F.month(s.time))
    sums = stored(bootstrap.block_sums(days, "_day", s.y, "pred", "base", by=["fold"]), "blocks")
    sampled = stored(bootstrap.draws_by(sums, n_draws, "fold", seeds), "draws")
    point = sums.groupBy("fold").agg(((F.sum("abs_b") - F.sum("abs_a")) / F.sum("n")).alias("d_mae"), (F.sqrt(F.sum("sq_b") / F.sum("n")) - F.sqrt(F.sum("sq_a") / F.sum("n"))).alias("d_rmse")).collect()
    out: dict[int, dict] = {r.fold: {"months": [], "night": {}} for r in point}
    for c in ("d_mae", "d_rmse"):
        at = {r.fold: r[c] for r in point}
        for r in bootstrap.interval(sampled, c, by=["fold"]).collect():
            out[r.fold][c] = r.asDict() | {"point": at[r.fold]}
    for r in segments.win_table(days, ["fold", "_month"], s.y, "pred", "base").orderBy("_month").collect():
        out[r.fold]["months"].append(r.asDict())
    for r in segments.night_rollup(days, "_hour", s.y, "pred", "base", by=["fold"]).collect():
        out[r.fold]["night"][r.part] = r.asDict()
    for w in out.values():
        w["months_won"] = sum(r["winner"] == "a" for r in w["months"])
    return out


def audit_window(s: Setup, scored: DataFrame, n_draws: int = DRAWS, seed: int = DRAW_SEED) -> dict:
    """Bootstrap by day, months won and night hours for rows scored by both models (pred and base)."""
    return audit_windows(s, scored.withColumn("fold", F.lit(0)), {0: seed}, n_draws)[0]


def audit(s: Setup, dev: DataFrame, cuts: list[str], until: list[str], final: DataFrame, n_draws: int = DRAWS, seed: int = DRAW_SEED) -> tuple[dict, list[dict], dict]:
    """(final window, development windows, verdict): final holds the final window's rows scored by the frozen model and baseline (pred, base), which are not fitted
    again; the development windows are fitted before their cuts. The first of these draws with seed + 1, the others with seed + 10 and on."""
    scored = windows(s, dev, cuts, until)
    columns = [s.time, s.y, "pred", "base"]
    rows = scored.select("fold", *columns).unionByName(final.select(F.lit(-1).alias("fold"), *columns))
    found = audit_windows(s, rows, {-1: seed} | {i: seed + 1 if i == 0 else seed + 9 + i for i in range(len(cuts))}, n_draws)
    development = [found[i] for i in range(len(cuts))]
    return found[-1], development, verdict(found[-1], development)


def verdict(final: dict, development: list[dict]) -> dict:
    """What audits allow to say: whether a is better for sure, probably, or not, on the final window; and how many others agree."""
    f = final["d_mae"]
    better = f["better_pct"] > 50
    return {
        "final": "better" if better and f["excludes_zero"] else "probably_better" if better else "not_better", "interval": [f["ci_low"], f["ci_high"]], "point": f["point"],
        "months": f"{final['months_won']}/{len(final['months'])}", "windows_better": sum(w["d_mae"]["point"] > 0 for w in development), "n_windows": len(development),
        "all_windows_agree": all(w["d_mae"]["better_pct"] > 50 for w in development),
    }


def run_all(s: Setup, dev: DataFrame, older: str, cut: str, year_start: str, cuts: list[str], until: list[str], drift_columns: list[str], reference_year: int) -> dict:
    """Every experiment on one development frame."""
    s.guard(dev, "run_all")
    dev = dev.cache()
    try:
        return {
            "random_vs_time": random_vs_time(s, dev, cut), "training_arms": training_arms(s, dev, older, year_start), "alternate_months": alternate_months(s, dev, year_start),
            "rolling_origin": rolling_origin(s, dev, cuts, until), "covariate_drift": covariate_drift(s, dev, drift_columns, reference_year), "night_hours": night_hours(s, dev, cuts, until),
            "log_target": log_target(s, dev, cut), "alpha_sensitivity": alpha_sensitivity(s, s.before(dev, year_start), s.since(dev, year_start)),
            "test_window_bias": test_window_bias(s, s.before(dev, year_start), s.since(dev, year_start)), "lag_leak": lag_leak(s, dev, cut),
        }
    finally:
        dev.unpersist()
