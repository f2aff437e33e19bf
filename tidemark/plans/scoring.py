"""Batch scoring of requests: validation, features, warnings, prediction and clipping, row by row in one plan."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.functions.calendar import NO_HOLIDAY, STATE_FAIR, add_calendar_features, add_holiday_flag, is_year_known
from tidemark.functions.numbers import celsius_to_kelvin, is_finite
from tidemark.operators.collapse import add_extreme_flags
from tidemark.operators.ridge import Ridge
from tidemark.plans.policy import require_frozen
from tidemark.sources.artifacts import read_json, write_json

#: What a request may hold.
TEMPERATURE, PRECIPITATION, CLOUDS, YEARS = (-70.0, 70.0), (0.0, 500.0), (0, 100), (1900, 2200)
RAIN_LABELS, SNOW_LABELS = ("Rain", "Drizzle", "Thunderstorm"), ("Snow",)
FIELDS = ("date_time", "temperature_celsius", "rain_1h_mm", "snow_1h_mm", "clouds_all", "weather", "state_fair_start_date")


def _error(field: str, code: str, bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))


def validate(requests: DataFrame) -> DataFrame:
    """Adds errors, an array of (field, code), empty for a valid request. Columns that no request has are refused at once."""
    extra = sorted(set(requests.columns) - {"request_id", *FIELDS})
    if extra:
        raise ValueError(f"unknown fields: {', '.join(extra)}")
    c = F.col
    outside = lambda name, low, high: ~c(name).between(low, high) | F.isnan(c(name).cast("double"))
    weather = F.coalesce(c("weather"), F.array().cast("array<string>"))
    errors = [
        _error("date_time", "missing", c("date_time").isNull()), _error("date_time", "range", ~F.year("date_time").between(*YEARS)),
        _error("temperature_celsius", "missing", c("temperature_celsius").isNull()), _error("temperature_celsius", "range", outside("temperature_celsius", *TEMPERATURE)),
        _error("rain_1h_mm", "range", outside("rain_1h_mm", *PRECIPITATION)), _error("snow_1h_mm", "range", outside("snow_1h_mm", *PRECIPITATION)),
        _error("clouds_all", "missing", c("clouds_all").isNull()), _error("clouds_all", "range", ~c("clouds_all").between(*CLOUDS)),
        _error("weather", "missing", F.size(weather) == 0), _error("weather", "unknown", F.exists(weather, lambda w: ~F.coalesce(w, F.lit("")).isin(*L.MAIN_SEVERITY))),
        _error("state_fair_start_date", "other_year", F.year("state_fair_start_date") != F.year("date_time")),
    ]
    return requests.withColumn("errors", F.array_compact(F.array(*errors)))


def features(requests: DataFrame) -> DataFrame:
    """The columns that training rows have, by the same functions. Labels count once each, so their mode is the least name; families come from labels."""
    labels = F.array_sort(F.array_distinct("weather"))
    df = requests.withColumns({
        "temp": celsius_to_kelvin(F.col("temperature_celsius")), "rain_1h": F.coalesce("rain_1h_mm", F.lit(0.0)), "snow_1h": F.coalesce("snow_1h_mm", F.lit(0.0)),
        "weather_main_mode": F.get(labels, 0), "weather_main_set": F.array_join(labels, "; "), "weather_main_n": F.size(labels), "weather_family": L.family_of_labels(labels),
        "weather_severity": F.array_max(F.transform(labels, lambda w: L.severity(w, L.MAIN_SEVERITY))),
    } | {f"wm_{L.slug_of(k)}": F.array_contains("weather", k).cast("int") for k in L.MAIN_SEVERITY})
    df = add_extreme_flags(add_calendar_features(add_holiday_flag(df, "date_time"), "date_time"))
    fair = ~is_year_known(F.year("date_time")) & (F.to_date("date_time") == F.col("state_fair_start_date"))
    named = F.when(F.coalesce(fair, F.lit(False)), "State Fair").otherwise(F.col("holiday_name"))
    return df.withColumn("holiday_name", named).withColumn("is_holiday", (F.col("holiday_name") != NO_HOLIDAY).cast("int"))


def warnings(requests: DataFrame, first: str, last: str) -> DataFrame:
    """Adds warnings: times outside the data's range, years without a State Fair day, precipitation that was not sent (null; an explicit 0 is fine)."""
    when = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), code)
    implies = lambda names: F.exists("weather", lambda w: w.isin(*names))
    t = F.col("date_time")
    out = [
        when(~t.between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")), "outside_range"), when(~is_year_known(F.year(t)), "state_fair_unknown"),
        when(F.col("rain_1h_mm").isNull() & implies(RAIN_LABELS), "rain_missing_but_implied"), when(F.col("rain_1h_mm").isNull() & ~implies(RAIN_LABELS), "rain_missing"),
        when(F.col("snow_1h_mm").isNull() & implies(SNOW_LABELS), "snow_missing_but_implied"), when(F.col("snow_1h_mm").isNull() & ~implies(SNOW_LABELS), "snow_missing"),
    ]
    return requests.withColumn("warnings", F.array_compact(F.array(*out)))


def respond(scored: DataFrame, policy: dict | None) -> DataFrame:
    """Adds prediction from raw_prediction: clipped at zero under the policy (and, with a warning, without any); null and an error if it is not finite."""
    clip = policy is None or policy.get("policy_id") == "non_negative_projection"
    raw, ok = F.col("raw_prediction"), is_finite(F.col("raw_prediction")) & (F.size("errors") == 0)
    out = scored.withColumn("prediction", F.when(ok, F.greatest(F.lit(0.0), raw) if clip else raw))
    out = out.withColumn("clipped", F.coalesce(ok & (F.col("prediction") != raw), F.lit(False)))
    out = out.withColumn("errors", F.when((F.size("errors") == 0) & ~ok, F.array(F.struct(F.lit("prediction").alias("field"), F.lit("not_finite").alias("code")))).otherwise(F.col("errors")))
    return out.withColumn("warnings", F.concat("warnings", F.array(F.lit("policy_missing"))) if policy is None else F.col("warnings"))


def score(requests: DataFrame, model, first: str, last: str, policy: dict | None) -> DataFrame:
    """Every request with errors, warnings, prediction: the whole path in one plan."""
    checked = warnings(features(validate(requests)), first, last)
    return respond(model.predict(checked, "raw_prediction"), policy)


class Registry:
    """Artifacts of one folder: model, baseline table, metadata, policy and run configuration, read once."""

    NAMES = ("ridge_model", "baseline_table", "model_metadata", "serving_policy", "run_config")

    def __init__(self, folder: str | Path):
        self.folder, self._found = Path(folder), {}

    def get(self, name: str) -> object | None:
        if name not in self.NAMES:
            raise KeyError(name)
        if name not in self._found:
            self._found[name] = read_json(self.folder / f"{name}.json")
        return self._found[name]

    def require(self, name: str) -> object:
        """The artifact, or an error that says what is missing and where it was looked for."""
        found = self.get(name)
        if found is None:
            raise FileNotFoundError(f"{name} is missing or no JSON: {self.folder / name}.json")
        return found

    def manifest(self) -> dict[str, bool]:
        return {n: self.get(n) is not None for n in self.NAMES}

    def reset(self) -> None:
        self._found.clear()

    def save(self, model: Ridge, baseline: DataFrame, policy: dict, metadata: dict) -> None:
        """Writes what serving needs; the baseline table has one row a group."""
        write_json(self.folder / "ridge_model.json", model.to_dict())
        write_json(self.folder / "baseline_table.json", [r.asDict() for r in baseline.collect()])
        write_json(self.folder / "serving_policy.json", policy)
        write_json(self.folder / "model_metadata.json", metadata)
        self.reset()

    def model(self) -> Ridge:
        return Ridge.from_dict(self.require("ridge_model"))

    def baseline(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r["hour"], r["day_of_week"], r["baseline_pred"]) for r in self.require("baseline_table")], "hour int, day_of_week int, baseline_pred double")

    def policy(self) -> dict:
        """The frozen policy; one that was changed since is refused."""
        return require_frozen(self.require("serving_policy"))

    def score(self, requests: DataFrame, first: str, last: str) -> DataFrame:
        """Requests scored by the stored model under the stored policy."""
        return score(requests, self.model(), first, last, self.policy())


KNOWN_YEARS = tuple(STATE_FAIR)
