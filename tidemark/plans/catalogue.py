"""The library's operators on the driver's tables, each beside the SQL that it must equal.

Orders play the observations (their date is the time, several a day, priorities the labels, prices the measure), events the
hourly series. A prediction is the mean by hour and weekday, or by month and weekday, over the days before a cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar as C
from tidemark.functions import labels as L
from tidemark.functions import numbers as N
from tidemark.operators import bootstrap, collapse, drift, explore, lags, quality, quantiles, ridge, segments, splits
from tidemark.operators.segments import metrics
from tidemark.plans import policy, scoring
from tidemark.plans.baseline import CUT, fit_group_mean, hourly, predict_group_mean
from tidemark.plans.solved import one_hot, solved
from tidemark.session import table
from tidemark.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TRAIN_UNTIL, VALIDATION_UNTIL = "1999-01-01 00:00:00", "2000-01-01 00:00:00"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SCALE = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "5-LOW": 0}


def query(name: str, sql: str | None = None, digits: int | dict[str, int] | None = 6):
    """Registers a query. Operators work in full precision; here their doubles are rounded, as in the SQL (None: left as they are)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f if digits is None else lambda spark, sf_dir: N.round_doubles(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hour_ts, y and the calendar's columns, one row an hour."""
    return C.add_calendar_features(hourly(events(spark, sf_dir)), "hour_ts")


def scored_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from the cut on with the baseline's pred, and as a second model base, the training mean."""
    df = stored(hours(spark, sf_dir), "hours")  # small, and read by means, fallbacks and test rows: events are scanned once
    cut = F.lit(CUT).cast("timestamp_ntz")
    train, test = df.where(F.col("hour_ts") < cut), df.where(F.col("hour_ts") >= cut)
    keys = ["hour", "day_of_week"]
    return predict_group_mean(test, fit_group_mean(train, keys), train, keys).join(F.broadcast(train.agg(F.avg("y").alias("base"))))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, y (mean price), n, labels (array), and the calendar's columns, one row an order date."""
    df = orders(spark, sf_dir).groupBy(F.col("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("y"), F.count("*").alias("n_orders"), F.collect_set("o_orderpriority").alias("labels"))
    return C.add_calendar_features(df, "day")


def scored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(days(spark, sf_dir), "days")
    train, _, test = splits.time_split(df, "day", TRAIN_UNTIL, VALIDATION_UNTIL)
    keys = ["month", "day_of_week"]
    return predict_group_mean(test, fit_group_mean(train, keys), train, keys)


HOURS = """h AS (SELECT date_trunc('hour', ts) AS hour_ts, sum(value) AS y FROM events WHERE ts IS NOT NULL GROUP BY 1),
hours AS (SELECT hour_ts, y, hour(hour_ts)::INT AS hour, (isodow(hour_ts) - 1)::INT AS day_of_week, month(hour_ts)::INT AS month, year(hour_ts)::INT AS year FROM h)"""
SCORED_HOURS = f"""{HOURS}, tr AS (SELECT * FROM hours WHERE hour_ts < TIMESTAMP '{CUT}'),
bm AS (SELECT hour, day_of_week, avg(y) AS p FROM tr GROUP BY ALL),
s AS (SELECT x.*, coalesce(bm.p, (SELECT avg(y) FROM tr)) AS pred, (SELECT avg(y) FROM tr) AS base FROM hours x LEFT JOIN bm USING (hour, day_of_week) WHERE hour_ts >= TIMESTAMP '{CUT}')"""
DAYS = """d AS (SELECT o_orderdate AS day, avg(o_totalprice) AS y, count(*) AS n_orders, list(DISTINCT o_orderpriority) AS labels FROM orders GROUP BY 1),
days AS (SELECT *, (isodow(day) - 1)::INT AS day_of_week, month(day)::INT AS month, year(day)::INT AS year FROM d)"""
SCORED_DAYS = f"""{DAYS}, tr AS (SELECT * FROM days WHERE day < TIMESTAMP '{TRAIN_UNTIL}'),
bm AS (SELECT month, day_of_week, avg(y) AS p FROM tr GROUP BY ALL),
s AS (SELECT x.*, coalesce(bm.p, (SELECT avg(y) FROM tr)) AS pred FROM days x LEFT JOIN bm USING (month, day_of_week) WHERE day >= TIMESTAMP '{VALIDATION_UNTIL}')"""
REPORT = "count(pred - y) AS n, round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(avg(pred - y), 6) AS bias, round(avg(y), 6) AS mean_actual, round(avg(pred), 6) AS mean_pred, count(pred - y) < 100 AS small_sample"


# --- sources, projections, filters ---------------------------------------------------------------------------------


@query(
    "schema_coercion",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS not_a_number,
  TRY_CAST(left(CAST(ts AS VARCHAR), 19) AS TIMESTAMP) AS t, coalesce(event_type, '') AS label FROM events WHERE ts IS NOT NULL""", digits=None)
def schema_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = events(spark, sf_dir).where("ts is not null").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("not_a_number"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"), F.col("event_type").alias("label"))
    return quality.coerce(text, timestamps=["t"], doubles=["k", "not_a_number"], strings=["label"])


@query(
    "invalid_to_null",
    """SELECT count(*) AS n_rows, count(*) FILTER (l_discount IS NOT NULL AND NOT (l_discount > 0)) AS invalid_l_discount, count(*) FILTER (l_tax IN (0.08, 0.0)) AS invalid_l_tax,
  count(*) FILTER (l_discount IS NULL OR NOT (l_discount > 0)) AS null_l_discount, count(*) FILTER (l_tax IS NULL OR l_tax IN (0.08, 0.0)) AS null_l_tax FROM lineitem""",
)
def invalid_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag_invalid(table(spark, sf_dir, "lineitem").select("l_discount", "l_tax"), ["l_discount"], {"l_tax": [0.08, 0.0]})[1]


@query(
    "finite_and_clip",
    "SELECT event_id, greatest(0.0::DOUBLE, value - 50) AS clipped, (value IS NOT NULL AND isfinite(value)) AS finite FROM events", digits=None)
def finite_and_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", N.non_negative(F.col("value") - 50).alias("clipped"), N.is_finite(F.col("value")).alias("finite"))


# --- quality --------------------------------------------------------------------------------------------------------


@query(
    "duplicate_audit",
    """WITH g AS (SELECT o_orderdate, count(*) AS n, count(DISTINCT o_orderstatus) + max((o_orderstatus IS NULL)::INT) AS ds, count(DISTINCT o_orderpriority) + max((o_orderpriority IS NULL)::INT) AS dp FROM orders GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_groups, count(*) FILTER (n > 1) AS n_duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_duplicates,
  min(n) FILTER (n > 1) AS min_size, max(n) FILTER (n > 1) AS max_size, count(*) FILTER (n > 1 AND ds > 1) AS varies_o_orderstatus, count(*) FILTER (n > 1 AND dp > 1) AS varies_o_orderpriority FROM g""",
)
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_audit(orders(spark, sf_dir), ["o_orderdate"], ["o_orderstatus", "o_orderpriority"])


@query(
    "invariant_violations",
    """SELECT o_orderdate, 'o_orderstatus' AS column_name, (count(DISTINCT o_orderstatus) + max((o_orderstatus IS NULL)::INT))::BIGINT AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) + max((o_orderstatus IS NULL)::INT) > 1""",
)
def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.invariant_violations(orders(spark, sf_dir), ["o_orderdate"], ["o_orderstatus"])


@query(
    "gap_audit_days",
    """WITH p AS (SELECT DISTINCT date_trunc('day', o_orderdate)::TIMESTAMP AS t FROM orders WHERE o_orderdate IS NOT NULL)
SELECT g.t::TIMESTAMP AS missing FROM (SELECT unnest(generate_series((SELECT min(t) FROM p), (SELECT max(t) FROM p), INTERVAL 1 DAY)) AS t) g ANTI JOIN p ON g.t = p.t""",
)
def gap_audit_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_steps(orders(spark, sf_dir), "o_orderdate", "DAY")


@query(
    "gap_audit_hours",
    """WITH p AS (SELECT DISTINCT user_id, date_trunc('hour', ts)::TIMESTAMP AS t FROM events WHERE ts IS NOT NULL),
b AS (SELECT user_id, min(t) AS a, max(t) AS z, count(*) AS present FROM p GROUP BY 1)
SELECT user_id, a AS first, z AS last, present, (date_diff('hour', a, z) + 1)::BIGINT AS expected, (date_diff('hour', a, z) + 1 - present)::BIGINT AS missing,
  round((date_diff('hour', a, z) + 1 - present) / (date_diff('hour', a, z) + 1)::DOUBLE, 6) AS missing_ratio FROM b""",
)
def gap_audit_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(events(spark, sf_dir), "ts", "HOUR", ["user_id"])


@query(
    "quantiles_by_digits",
    """WITH x AS (SELECT l_returnflag, unnest(['l_extendedprice', 'l_quantity']) AS column_name, unnest([l_extendedprice::DOUBLE, l_quantity::DOUBLE]) AS v FROM lineitem),
q AS (SELECT l_returnflag, column_name, quantile_cont(v, [0.05, 0.5, 0.95]) AS q FROM x GROUP BY ALL)
SELECT l_returnflag, column_name, unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS share, round(unnest(q), 6) AS value FROM q""",
)
def quantiles_by_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of two columns by group, found by counting digits instead of in a buffer of all values."""
    return quantiles.quantiles(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], [0.05, 0.5, 0.95], ["l_returnflag"])


_RUNS = """WITH p AS (SELECT DISTINCT {by}{t} AS t FROM {rel} WHERE {c} IS NOT NULL), n AS (SELECT *, lead(t) OVER ({part}ORDER BY t) AS nxt FROM p)
SELECT {by}t + INTERVAL 1 {step} AS "from", nxt - INTERVAL 1 {step} AS "to", (date_diff('{step}', t, nxt) - 1)::BIGINT AS steps FROM n WHERE date_diff('{step}', t, nxt) > 1"""


@query("gap_runs_hours", _RUNS.format(by="user_id, ", t="date_trunc('hour', ts)::TIMESTAMP", c="ts", rel="events", part="PARTITION BY user_id ", step="hour"), digits=None)
def gap_runs_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours in which a user has no event."""
    return quality.missing_runs(events(spark, sf_dir), "ts", "HOUR", ["user_id"], bucket_steps=100)


@query("gap_runs_days", _RUNS.format(by="", t="date_trunc('day', o_orderdate)::TIMESTAMP", c="o_orderdate", rel="orders", part="", step="day"), digits=None)
def gap_runs_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_runs(orders(spark, sf_dir), "o_orderdate", "DAY", bucket_steps=365)


@query(
    "holiday_audit",
    f"""SELECT holiday, count(*) AS n_rows, count(DISTINCT o_orderdate::DATE) AS n_days FROM (SELECT o_orderdate, {C.holiday_sql("o_orderdate")} AS holiday FROM orders) WHERE holiday NOT IN ('', 'None') GROUP BY 1""",
)
def holiday_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.holiday_audit(orders(spark, sf_dir).select("o_orderdate", C.holiday_name(F.to_date("o_orderdate")).alias("h")), "o_orderdate", "h")


@query(
    "holiday_reconcile",
    f"""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), a AS (SELECT day, {C.holiday_sql("day")} AS name FROM d),
l AS (SELECT * FROM a WHERE name <> 'None' AND day(day) <> 25), r AS (SELECT day, CASE WHEN name LIKE 'V%' THEN 'other' ELSE name END AS name FROM a WHERE name <> 'None' AND month(day) <> 7)
SELECT count(*) FILTER (l.name = r.name) AS n_matched, count(*) FILTER (l.name <> r.name) AS n_named_otherwise, count(*) FILTER (l.name IS NOT NULL AND r.name IS NULL) AS n_only_left, count(*) FILTER (r.name IS NOT NULL AND l.name IS NULL) AS n_only_right
FROM l FULL JOIN r ON l.day = r.day""",
)
def holiday_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar against a list with days and names taken out, so that all four counts show."""
    all_days = orders(spark, sf_dir).select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("name", C.holiday_name(F.col("day"))).where("name <> 'None'")
    left = all_days.where(F.dayofmonth("day") != 25)
    right = all_days.where(F.month("day") != 7).withColumn("name", F.when(F.col("name").startswith("V"), "other").otherwise(F.col("name")))
    return quality.reconcile(left, right, "day", "name")


# --- collapse and labels --------------------------------------------------------------------------------------------



@query(
    "collapse_orders_daily",
    """WITH c AS (SELECT o_orderdate, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT o_orderdate, p, row_number() OVER (PARTITION BY o_orderdate ORDER BY n DESC, p) AS k FROM c)
SELECT o.o_orderdate, round(quantile_cont(o_totalprice, 0.5), 4) AS price, count(*) AS n_obs, any_value(m.p) AS label_mode, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS label_set, count(DISTINCT o_orderpriority)::INT AS label_n
FROM orders o JOIN m ON m.o_orderdate = o.o_orderdate AND k = 1 GROUP BY 1""", digits=4)
def collapse_orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse.collapse(orders(spark, sf_dir), ["o_orderdate"], [], ["o_totalprice"], collapse.label_aggregates("o_orderpriority", "label"))
    return out.select("o_orderdate", F.col("o_totalprice").alias("price"), "n_obs", "label_mode", "label_set", "label_n")


@query(
    "label_multi_hot",
    "SELECT o_orderdate, " + ", ".join(f"max((o_orderpriority = '{p}')::INT) AS {L.slug_of('p ' + p)}" for p in PRIORITIES) + ", max(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 0 ELSE 2 END) AS severity FROM orders GROUP BY 1",
)
def label_multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse.label_aggregates("o_orderpriority", "label", PRIORITIES, SCALE, "p")
    out = orders(spark, sf_dir).groupBy("o_orderdate").agg(*found).withColumnRenamed("label_severity", "severity")
    return out.select("o_orderdate", *(L.slug_of(f"p {p}") for p in PRIORITIES), "severity")


@query(
    "most_severe_label",
    """WITH x AS (SELECT o_orderdate, o_orderpriority AS p, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 0 ELSE 2 END AS s FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY s DESC, p DESC) AS k FROM x) SELECT o_orderdate, p AS label FROM r WHERE k = 1""",
)
def most_severe_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).groupBy("o_orderdate").agg(collapse.most_severe(F.col("o_orderpriority"), SCALE).alias("label"))


WORDS = (("promo", "campaign"), ("econ", "budget"), ("standard", "regular"), ("mall", "compact"))


@query(
    "keyword_family",
    "SELECT p_partkey, " + "CASE " + " ".join(f"WHEN instr(lower(trim(p_type)), '{w}') > 0 THEN '{v}'" for w, v in WORDS) + " ELSE 'other' END AS family FROM part",
)
def keyword_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", L.first_keyword(F.col("p_type"), WORDS).alias("family"))


@query(
    "weather_family",
    "SELECT event_id, " + "CASE " + " ".join(f"WHEN instr(lower(trim(d)), '{w}') > 0 THEN '{v}'" for w, v in L.FAMILY_WORDS) + " ELSE 'other' END AS family FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'sky is Clear' WHEN 1 THEN 'light rain and snow' WHEN 2 THEN ' SQUALLS' WHEN 3 THEN 'overcast clouds' WHEN 4 THEN 'proximity shower rain' ELSE event_type END AS d FROM events)",
)
def weather_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["sky is Clear", "light rain and snow", " SQUALLS", "overcast clouds", "proximity shower rain"]
    k = F.col("event_id") % 6
    d = F.col("event_type")
    for i, t in enumerate(texts):
        d = F.when(k == i, t).otherwise(d)
    return events(spark, sf_dir).select("event_id", L.first_keyword(d).alias("family"))


@query(
    "slug",
    r"SELECT n_nationkey, lower(regexp_replace(regexp_replace(n_name || ' (x)', '[^0-9a-zA-Z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM nation",
)
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", L.slug(F.concat("n_name", F.lit(" (x)"))).alias("slug"))


# --- calendar -------------------------------------------------------------------------------------------------------


@query(
    "calendar_features",
    """SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week, month(ts)::INT AS month, year(ts)::INT AS year, (isodow(ts) >= 6)::INT AS is_weekend, hour(ts) || '_' || (isodow(ts) - 1) AS hour_dow FROM events""",
)
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.add_calendar_features(events(spark, sf_dir).select("event_id", "ts"), "ts").drop("ts")


@query(
    "holiday_flag",
    f"SELECT o_orderkey, holiday_name, (holiday_name <> 'None')::INT AS is_holiday FROM (SELECT o_orderkey, {C.holiday_sql('o_orderdate')} AS holiday_name FROM orders)",
)
def holiday_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.add_holiday_flag(orders(spark, sf_dir).select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "holiday_nth_weekday",
    "SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE month(o_orderdate) = 11 AND isodow(o_orderdate) = 4 AND day(o_orderdate) BETWEEN 22 AND 28",
)
def holiday_nth_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return orders(spark, sf_dir).where(C.is_nth_weekday(d, 11, 3, 4)).select(d.alias("day")).distinct()


@query(
    "holiday_last_weekday",
    "SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE month(o_orderdate) = 5 AND isodow(o_orderdate) = 1 AND day(o_orderdate) > 24",
)
def holiday_last_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return orders(spark, sf_dir).where(C.is_last_weekday(d, 5, 0)).select(d.alias("day")).distinct()


# --- splits ---------------------------------------------------------------------------------------------------------

_SPLIT = f"CASE WHEN o_orderdate < TIMESTAMP '{TRAIN_UNTIL}' THEN 'train' WHEN o_orderdate < TIMESTAMP '{VALIDATION_UNTIL}' THEN 'validation' ELSE 'test' END"


@query(
    "time_split_summary",
    f"SELECT {_SPLIT} AS split, count(*) AS n, min(o_orderdate) AS start, max(o_orderdate) AS \"end\", string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS years FROM orders GROUP BY 1",
)
def time_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_summary(splits.with_split(orders(spark, sf_dir), "o_orderdate", TRAIN_UNTIL, VALIDATION_UNTIL), "o_orderdate")


@query(
    "split_overlap",
    "SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'",
)
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, test = splits.time_split(orders(spark, sf_dir), "o_orderdate", TRAIN_UNTIL, VALIDATION_UNTIL)
    return splits.overlap(train, test, ["o_custkey"])


@query(
    "random_split_hash",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def random_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_split(orders(spark, sf_dir).select("o_orderkey"), ["o_orderkey"], 42)


@query("seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5('11|' || o_orderkey), o_orderkey LIMIT 500")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_rows(orders(spark, sf_dir).select("o_orderkey"), ["o_orderkey"], 11, 500)


# --- baseline and segments ------------------------------------------------------------------------------------------


@query("baseline_table", f"WITH {HOURS} SELECT hour, day_of_week, round(avg(y), 6) AS baseline_pred FROM hours WHERE hour_ts < TIMESTAMP '{CUT}' GROUP BY ALL")
def baseline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = events(spark, sf_dir).where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"))  # the cut is on the hour, so this bound on ts reaches the scan
    train = C.add_calendar_features(hourly(before), "hour_ts")
    return fit_group_mean(train, ["hour", "day_of_week"])


@query("baseline_predict", f"WITH {SCORED_HOURS} SELECT hour_ts, round(y, 6) AS y, round(pred, 6) AS pred FROM s")
def baseline_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_hours(spark, sf_dir).select("hour_ts", F.col("y").alias("y"), F.col("pred").alias("pred"))


@query("segment_by_hour", f"WITH {SCORED_HOURS} SELECT hour, {REPORT} FROM s GROUP BY 1")
def segment_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.report(scored_hours(spark, sf_dir), ["hour"])


@query("segment_by_dow", f"WITH {SCORED_HOURS} SELECT day_of_week, {REPORT} FROM s GROUP BY 1")
def segment_by_dow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.report(scored_hours(spark, sf_dir), ["day_of_week"])


@query("segment_by_holiday", f"WITH {SCORED_DAYS} SELECT is_holiday, {REPORT} FROM (SELECT *, ({C.holiday_sql('day')} <> 'None')::INT AS is_holiday FROM s) GROUP BY 1")
def segment_by_holiday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.report(C.add_holiday_flag(scored_days(spark, sf_dir), "day"), ["is_holiday"])


@query("segment_by_label", f"WITH {SCORED_DAYS} SELECT label, {REPORT} FROM (SELECT y, pred, unnest(labels) AS label FROM s) GROUP BY 1")
def segment_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.report_by_labels(scored_days(spark, sf_dir), "labels")


@query(
    "segment_by_flags",
    f"""WITH {SCORED_DAYS}, f AS (SELECT y, pred, list_contains(labels, '1-URGENT') AS urgent, list_contains(labels, '2-HIGH') AS high FROM s),
u AS (SELECT y, pred, 'urgent' AS label FROM f WHERE urgent UNION ALL SELECT y, pred, 'high' FROM f WHERE high UNION ALL SELECT y, pred, 'any' FROM f WHERE urgent OR high UNION ALL SELECT y, pred, 'none' FROM f WHERE NOT urgent AND NOT high)
SELECT label, {REPORT} FROM u GROUP BY 1""",
)
def segment_by_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored_days(spark, sf_dir).withColumns({n: F.array_contains("labels", p).cast("int") for n, p in (("urgent", "1-URGENT"), ("high", "2-HIGH"))})
    return segments.report_by_flags(df, ["urgent", "high"])


@query(
    "zero_sample_segments",
    f"""WITH {SCORED_DAYS}, r AS (SELECT month, {REPORT} FROM s GROUP BY 1), g AS (SELECT unnest(range(1, 15))::INT AS month)
SELECT g.month, coalesce(n, 0) AS n, mae, rmse, bias, mean_actual, mean_pred, coalesce(small_sample, true) AS small_sample FROM g LEFT JOIN r USING (month)""",
)
def zero_sample_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1, 15).select(F.col("id").cast("int").alias("month"))
    return segments.with_all_segments(segments.report(scored_days(spark, sf_dir), ["month"]), listed, ["month"])


@query(
    "worst_and_best_segment",
    f"WITH {SCORED_HOURS}, r AS (SELECT hour, avg(abs(pred - y)) AS mae FROM s GROUP BY 1) SELECT arg_max(hour, mae) AS worst, arg_min(hour, mae) AS best FROM r",
)
def worst_and_best_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.report(scored_hours(spark, sf_dir), ["hour"]).agg(F.max_by("hour", "mae").alias("worst"), F.min_by("hour", "mae").alias("best"))


_HOLIDAYS = f"f AS (SELECT *, {C.holiday_sql('day')} AS holiday_name, ({C.holiday_sql('day')} <> 'None')::INT AS is_holiday, (SELECT avg(y) FROM tr) AS base FROM s)"


def _holiday_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = splits.time_split(days(spark, sf_dir), "day", TRAIN_UNTIL, VALIDATION_UNTIL)[0]
    return C.add_holiday_flag(scored_days(spark, sf_dir), "day").join(F.broadcast(train.agg(F.avg("y").alias("base"))))


def _mae(p: str, v: int) -> str:
    return f"avg(abs(y - {p})) FILTER (is_holiday = {v})"


@query(
    "holiday_effect",
    f"""WITH {SCORED_DAYS}, {_HOLIDAYS}, r AS (SELECT count(*) FILTER (is_holiday = 1) AS n_flagged, count(*) FILTER (is_holiday = 0) AS n_rest, count(DISTINCT day::DATE) FILTER (is_holiday = 1) AS n_days,
  {_mae("pred", 1)} AS mae_a_flagged, {_mae("pred", 0)} AS mae_a_rest, {_mae("base", 1)} AS mae_b_flagged, {_mae("base", 0)} AS mae_b_rest FROM f)
SELECT n_flagged, n_rest, n_days, round(mae_a_flagged, 6) AS mae_a_flagged, round(mae_a_rest, 6) AS mae_a_rest, round(mae_b_flagged, 6) AS mae_b_flagged, round(mae_b_rest, 6) AS mae_b_rest, round(mae_a_flagged - mae_a_rest, 6) AS delta FROM r""",
)
def holiday_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.flag_effect(_holiday_days(spark, sf_dir), "is_holiday", "day", "y", "pred", "base")


@query("holiday_days", f"WITH {SCORED_DAYS}, {_HOLIDAYS} SELECT day::DATE AS day, any_value(holiday_name) AS name, count(*) AS n, round(avg(abs(y - pred)), 6) AS mae_a, round(avg(abs(y - base)), 6) AS mae_b FROM f WHERE is_holiday = 1 GROUP BY 1")
def holiday_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.by_day_of_flag(_holiday_days(spark, sf_dir), "is_holiday", "holiday_name", "day", "y", "pred", "base")


@query("categories_without_rows", f"WITH {DAYS} SELECT label FROM (SELECT unnest(['1-URGENT', '0-NEVER', '5-LOW', '6-NONE']) AS label) WHERE label NOT IN (SELECT unnest(labels) FROM days)")
def categories_without_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.categories_without_rows(days(spark, sf_dir), "labels", ["1-URGENT", "0-NEVER", "5-LOW", "6-NONE"])


@query("worst_months", f"WITH {SCORED_DAYS} SELECT month, {REPORT} FROM s GROUP BY 1 ORDER BY avg(abs(pred - y)) DESC, month LIMIT 3")
def worst_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.top_segments(scored_days(spark, sf_dir), "month", "y", "pred")


@query(
    "first_missing_days",
    """WITH p AS (SELECT DISTINCT date_trunc('day', o_orderdate)::TIMESTAMP AS t FROM orders WHERE o_orderdate IS NOT NULL), m AS (SELECT g.t FROM (SELECT unnest(generate_series((SELECT min(t) FROM p), (SELECT max(t) FROM p), INTERVAL 1 DAY)) AS t) g ANTI JOIN p ON g.t = p.t ORDER BY 1 LIMIT 10)
SELECT coalesce(string_agg(strftime(t, '%Y-%m-%d %H:%M'), ',' ORDER BY t), '') AS first, count(*) AS n_shown FROM m""",
)
def first_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_missing(orders(spark, sf_dir), "o_orderdate", "DAY")


# --- exploration ----------------------------------------------------------------------------------------------------


@query(
    "describe_target",
    "SELECT event_type, count(value) AS n, round(min(value), 6) AS least, round(max(value), 6) AS greatest, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (value = 0) AS n_zero FROM events GROUP BY 1",
)
def describe_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.describe(events(spark, sf_dir), "value", ["event_type"])


@query("pivot_hour_dow", f"WITH {HOURS} SELECT hour, " + ", ".join(f"round(avg(y) FILTER (day_of_week = {d}), 6) AS dow_{d}" for d in range(7)) + " FROM hours GROUP BY 1")
def pivot_hour_dow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.pivot_mean(hours(spark, sf_dir), "hour", "day_of_week", list(range(7)), "y", "dow_")


@query(
    "month_year_mean",
    """WITH g AS (SELECT DISTINCT year(o_orderdate)::INT AS year, m::INT AS month FROM orders, (SELECT unnest(range(1, 13)) AS m)), v AS (SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY ALL)
SELECT year, month, mean, coalesce(n, 0) AS n FROM g LEFT JOIN v USING (year, month)""", digits=4)
def month_year_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.month_year_mean(orders(spark, sf_dir), "o_orderdate", "o_totalprice")


@query("null_counts", "SELECT count(*) FILTER (o_totalprice IS NULL) AS null_o_totalprice, count(*) FILTER (o_orderdate IS NULL) AS null_o_orderdate FROM orders")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.null_counts(orders(spark, sf_dir), ["o_totalprice", "o_orderdate"])


@query(
    "year_coverage",
    "SELECT year(o_orderdate)::INT AS year, count(*) AS n_rows, count(DISTINCT o_orderdate) AS n_present, round(count(DISTINCT o_orderdate) / date_diff('day', make_date(year(o_orderdate), 1, 1), make_date(year(o_orderdate) + 1, 1, 1))::DOUBLE, 6) AS share FROM orders GROUP BY year(o_orderdate)",
)
def year_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.year_coverage(orders(spark, sf_dir), "o_orderdate", 86400)


@query("value_counts", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.value_counts(events(spark, sf_dir), "event_type")


@query("yearly_stats", "SELECT year(o_orderdate)::INT AS year, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_samp(o_totalprice), 4) AS sd, count(o_totalprice) AS n FROM orders GROUP BY 1", digits=4)
def yearly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.yearly_stats(orders(spark, sf_dir), "o_orderdate", "o_totalprice")


@query(
    "holiday_vs_rest",
    f"WITH {DAYS}, f AS (SELECT *, ({C.holiday_sql('day')} <> 'None')::INT AS h FROM days) SELECT day_of_week, round(avg(y) FILTER (h = 1), 6) AS mean_flagged, round(avg(y) FILTER (h = 0), 6) AS mean_rest, count(*) FILTER (h = 1) AS n_flagged, count(*) FILTER (h = 0) AS n_rest FROM f GROUP BY 1",
)
def holiday_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.flag_vs_rest(C.add_holiday_flag(days(spark, sf_dir), "day"), "day_of_week", "is_holiday", "y")


_SEASON = "CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month <= 5 THEN 'Spring' WHEN month <= 8 THEN 'Summer' ELSE 'Fall' END"


@query("season_mae", f"WITH {SCORED_DAYS} SELECT {_SEASON} AS season, {REPORT} FROM s GROUP BY 1")
def season_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.report(scored_days(spark, sf_dir).withColumn("season", segments.season_of(F.col("month"))), ["season"])


# --- comparisons of models ------------------------------------------------------------------------------------------

_PAIR = "count(*) AS n, avg(abs(y - pred)) AS a, avg(abs(y - base)) AS b, avg(y) AS m"


@query(
    "hour_compare_models",
    f"WITH {SCORED_HOURS}, r AS (SELECT hour, {_PAIR} FROM s GROUP BY 1) SELECT hour, n, round(a, 6) AS mae_a, round(b, 6) AS mae_b, round(m, 6) AS mean_actual, round(a / CASE WHEN m > 0 THEN m END, 6) AS rel_a, round(b / CASE WHEN m > 0 THEN m END, 6) AS rel_b, a > b AS a_worse FROM r",
)
def hour_compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.compare_by(scored_hours(spark, sf_dir), "hour", "y", "pred", "base")


@query(
    "night_rollup",
    f"WITH {SCORED_HOURS}, r AS (SELECT CASE WHEN hour <= 4 THEN 'night' ELSE 'day' END AS part, {_PAIR} FROM s GROUP BY 1) SELECT part, n, round(a, 6) AS mae_a, round(b, 6) AS mae_b, round(m, 6) AS mean_actual, round(a / CASE WHEN m > 0 THEN m END, 6) AS rel_a, round(b / CASE WHEN m > 0 THEN m END, 6) AS rel_b, a > b AS a_worse FROM r",
)
def night_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.night_rollup(scored_hours(spark, sf_dir), "hour", "y", "pred", "base")


@query(
    "win_table",
    f"WITH {SCORED_HOURS}, r AS (SELECT day_of_week, {_PAIR} FROM s GROUP BY 1) SELECT day_of_week, n, round(a, 6) AS mae_a, round(b, 6) AS mae_b, round(b - a, 6) AS delta, CASE WHEN a < b THEN 'a' ELSE 'b' END AS winner, n < 100 AS small_sample FROM r",
)
def win_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.win_table(scored_hours(spark, sf_dir), "day_of_week", "y", "pred", "base")


@query(
    "window_bias",
    f"""WITH {SCORED_DAYS}, r AS (SELECT count(y - pred) AS n, avg(abs(y - pred)) AS a, avg(abs(y - pred)) FILTER (month <= 9) AS f, avg(abs(y - pred)) FILTER (month > 9) AS z, count(*) FILTER (month <= 9) AS n_first, count(*) FILTER (month > 9) AS n_rest FROM s)
SELECT n, round(a, 6) AS mae_all, round(f, 6) AS mae_first, round(z, 6) AS mae_rest, n_first, n_rest, round(f - a, 6) AS delta FROM r""",
)
def window_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.window_bias(scored_days(spark, sf_dir), "month", "y", "pred")


_CENTRED = "c AS (SELECT o_totalprice / 1000 AS y, o_totalprice / 1000 - (SELECT avg(o_totalprice) / 1000 FROM orders) AS pred, o_orderdate FROM orders)"


def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir)
    return df.join(F.broadcast(df.agg((F.avg("o_totalprice") / 1000).alias("m")))).select((F.col("o_totalprice") / 1000).alias("y"), (F.col("o_totalprice") / 1000 - F.col("m")).alias("pred"), "o_orderdate")


@query(
    "clip_audit",
    f"""WITH {_CENTRED}, e AS (SELECT *, abs(y - pred) AS a, abs(y - greatest(0.0::DOUBLE, pred)) AS b FROM c)
SELECT count(*) AS n, count(*) FILTER (pred < 0) AS n_negative, round(100.0 * count(*) FILTER (pred < 0) / count(*)::DOUBLE, 6) AS negative_pct, round(min(pred), 6) AS min_pred, round(avg(y) FILTER (pred < 0), 6) AS mean_actual_negative,
  round(avg(a), 6) AS mae_raw, round(avg(b), 6) AS mae_clipped, round(sqrt(avg(a * a)), 6) AS rmse_raw, round(sqrt(avg(b * b)), 6) AS rmse_clipped, bool_and(b <= a + 1e-9) AS never_worse, count(*) FILTER (a <> b) AS n_changed FROM e""",
)
def clip_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.clip_audit(_centred(spark, sf_dir), "y", "pred")


@query(
    "clipped_where",
    f"""WITH {_CENTRED}, e AS (SELECT *, month(o_orderdate)::INT AS m, ({C.holiday_sql("o_orderdate")} <> 'None')::INT AS h FROM c)
SELECT (SELECT string_agg(m::VARCHAR, ',' ORDER BY m) FROM (SELECT DISTINCT m FROM e WHERE pred < 0)) AS hours, (SELECT count(*) FROM e WHERE pred < 0 AND h = 1) AS n_flagged""",
)
def clipped_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.add_holiday_flag(_centred(spark, sf_dir), "o_orderdate").withColumn("m", F.month("o_orderdate"))
    return segments.clipped_where(df, "pred", "m", "is_holiday")


@query(
    "policy_decision",
    f"""WITH {_CENTRED}, t AS (SELECT * FROM c WHERE o_orderdate < TIMESTAMP '{TRAIN_UNTIL}'), v AS (SELECT * FROM c WHERE o_orderdate >= TIMESTAMP '{TRAIN_UNTIL}' AND o_orderdate < TIMESTAMP '{VALIDATION_UNTIL}'),
d AS (SELECT (SELECT min(y) >= 0 FROM t) AS floor_not_negative, (SELECT count(*) FROM (SELECT * FROM t UNION ALL SELECT * FROM v) WHERE pred < 0) > 0 AS goes_below_floor, (SELECT avg(abs(y - greatest(0.0::DOUBLE, pred))) <= avg(abs(y - pred)) FROM v) AS validation_not_worse)
SELECT CASE WHEN floor_not_negative AND goes_below_floor AND validation_not_worse THEN 'non_negative_projection' ELSE 'none' END AS policy_id, * FROM d""",
)
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation, _ = splits.time_split(_centred(spark, sf_dir), "o_orderdate", TRAIN_UNTIL, VALIDATION_UNTIL)
    found = policy.decide(train, validation, "y", "pred")
    row = {"policy_id": found["policy_id"], **found["decision"]}
    return spark.createDataFrame([tuple(row.values())], "policy_id string, floor_not_negative boolean, goes_below_floor boolean, validation_not_worse boolean")


@query(
    "seed_summary",
    "WITH v AS (SELECT user_id, sum(value) AS x FROM events GROUP BY 1) SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(min(x), 6) AS least, round(max(x), 6) AS greatest, count(x) AS n FROM v",
)
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.seed_summary(events(spark, sf_dir).groupBy("user_id").agg(F.sum("value").alias("x")), "x")


# --- time series ----------------------------------------------------------------------------------------------------

_LAG_SQL = "WITH u AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS t, sum(value) AS v FROM events WHERE ts IS NOT NULL GROUP BY ALL) SELECT a.user_id, a.t, round(b.v, 6) AS lag_1h, round(c.v, 6) AS lag_24h, round(d.v, 6) AS lag_168h FROM u a LEFT JOIN u b ON a.user_id = b.user_id AND a.t = b.t + INTERVAL 1 HOUR LEFT JOIN u c ON a.user_id = c.user_id AND a.t = c.t + INTERVAL 24 HOUR LEFT JOIN u d ON a.user_id = d.user_id AND a.t = d.t + INTERVAL 168 HOUR"


def _user_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("t")
    return events(spark, sf_dir).where("ts is not null").groupBy("user_id", t).agg(F.sum("value").alias("v"))


def _rounded_lags(df: DataFrame) -> DataFrame:
    return df.select("user_id", "t", *(f"lag_{k}h" for k in (1, 24, 168)))


@query("lag_timestamp", _LAG_SQL)
def lag_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_lags(lags.lag_by_time(_user_hours(spark, sf_dir), "t", "v", [1, 24, 168], ["user_id"]))


@query("lag_range_window", _LAG_SQL)
def lag_range_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_lags(lags.lag_by_range(_user_hours(spark, sf_dir), "t", "v", [1, 24, 168], ["user_id"]))


@query(
    "lag_row_shift",
    "WITH u AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS t, sum(value) AS v FROM events WHERE ts IS NOT NULL GROUP BY ALL) SELECT user_id, t, round(lag(v, 1) OVER w, 6) AS shift_1, round(lag(v, 24) OVER w, 6) AS shift_24 FROM u WINDOW w AS (PARTITION BY user_id ORDER BY t)",
)
def lag_row_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lags.lag_by_row(_user_hours(spark, sf_dir), "t", "v", [1, 24], ["user_id"])
    return out.select("user_id", "t", *(f"shift_{k}" for k in (1, 24)))


@query(
    "lag_complete_rows",
    f"WITH l AS ({_LAG_SQL}) SELECT count(*) AS n_before, count(*) FILTER (lag_1h IS NOT NULL AND lag_24h IS NOT NULL) AS n_after, round(100.0 * count(*) FILTER (lag_1h IS NOT NULL AND lag_24h IS NOT NULL) / count(*)::DOUBLE, 6) AS kept_pct FROM l",
)
def lag_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.complete_rows(lags.lag_by_time(_user_hours(spark, sf_dir), "t", "v", [1, 24], ["user_id"]), ["lag_1h", "lag_24h"])[1]


FOLD_CUTS, FOLD_ENDS = ["1998-01-01 00:00:00", "1999-01-01 00:00:00", "2000-01-01 00:00:00"], ["1999-01-01 00:00:00", "2000-01-01 00:00:00", "2001-01-01 00:00:00"]


@query(
    "rolling_origin_baseline",
    f"""WITH {DAYS}, f AS (SELECT * FROM (VALUES {", ".join(f"({i}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, (a, b) in enumerate(zip(FOLD_CUTS, FOLD_ENDS, strict=True)))}) t(fold, a, b)),
m AS (SELECT fold, month, avg(y) AS p FROM days, f WHERE day < a GROUP BY ALL), g AS (SELECT fold, avg(y) AS p FROM days, f WHERE day < a GROUP BY ALL),
s AS (SELECT f.fold, y, coalesce(m.p, g.p) AS pred FROM days JOIN f ON day >= a AND day < b LEFT JOIN m ON m.fold = f.fold AND m.month = days.month JOIN g ON g.fold = f.fold)
SELECT fold, {REPORT} FROM s GROUP BY 1""",
)
def rolling_origin_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.rolling_folds(days(spark, sf_dir), "day", FOLD_CUTS, FOLD_ENDS)
    train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    means = train.groupBy("fold", "month").agg(F.avg("y").alias("_m"))
    overall = train.groupBy("fold").agg(F.avg("y").alias("_g"))
    scored = test.join(means, ["fold", "month"], "left").join(F.broadcast(overall), "fold").withColumn("pred", F.coalesce("_m", "_g"))
    return segments.report(scored, ["fold"])


# --- drift, bootstrap, ridge ----------------------------------------------------------------------------------------


@query(
    "psi_by_year",
    """WITH x AS (SELECT year(o_orderdate)::INT AS year, o_totalprice AS v FROM orders),
q AS (SELECT list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM x WHERE year = 1996),
b AS (SELECT year, len(list_filter((SELECT e FROM q), lambda z: z <= v)) AS bin, count(*) AS n FROM x GROUP BY ALL),
t AS (SELECT year, sum(n) AS total FROM b GROUP BY 1), g AS (SELECT year, total, unnest(range(0, len((SELECT e FROM q)) + 1)) AS bin FROM t),
s AS (SELECT g.year, g.bin, greatest(coalesce(n, 0) / total, 1e-6) AS share FROM g LEFT JOIN b ON b.year = g.year AND b.bin = g.bin),
r AS (SELECT s.year, sum((s.share - o.share) * ln(s.share / o.share)) AS psi FROM s JOIN s o ON o.year = 1996 AND o.bin = s.bin WHERE s.year <> 1996 GROUP BY 1)
SELECT year, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'shifted' END AS verdict FROM r""",
)
def psi_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.psi(orders(spark, sf_dir).select(F.year("o_orderdate").alias("year"), "o_totalprice"), "o_totalprice", "year", 1996)


#: As many draws as the audits take, over calendar days.
N_DRAWS = 4000


@query(
    "block_bootstrap_ci",
    f"""WITH {SCORED_DAYS}, g AS (SELECT avg(y) AS base FROM tr), b AS (SELECT day AS block, count(*) AS n, sum(abs(y - pred)) AS a, sum(abs(y - base)) AS c FROM s, g GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS nth FROM b), k AS (SELECT count(*) AS blocks FROM b),
p AS (SELECT draw, ('0x' || substr(md5('7-' || draw || '-' || pick), 1, 8))::BIGINT % blocks AS nth FROM k, (SELECT unnest(range(0, {N_DRAWS})) AS draw) d, LATERAL (SELECT unnest(range(0, blocks)) AS pick) q),
z AS (SELECT draw, (sum(c) - sum(a)) / sum(n) AS d FROM p JOIN o USING (nth) GROUP BY 1)
SELECT count(d) AS n_draws, round(quantile_cont(d, 0.025), 4) AS ci_low, round(quantile_cont(d, 0.975), 4) AS ci_high, round(stddev_pop(d), 4) AS sd, round(100.0 * avg((d > 0)::INT::DOUBLE), 4) AS better_pct, (quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0) AS excludes_zero FROM z""", digits=4)
def block_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = splits.time_split(days(spark, sf_dir), "day", TRAIN_UNTIL, VALIDATION_UNTIL)[0]
    df = scored_days(spark, sf_dir).join(F.broadcast(train.agg(F.avg("y").alias("base")))).withColumn("block", F.col("day"))
    return bootstrap.interval(bootstrap.draws(bootstrap.block_sums(df, "block", "y", "pred", "base"), N_DRAWS, 7), "d_mae")


ALPHAS_1D = (0.001, 1.0, 100.0, 10000.0)
_RIDGE_1D = f"r AS (SELECT a AS alpha, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + a) AS slope, avg(y) AS my, avg(x) AS mx FROM w, (SELECT unnest([{', '.join(map(str, ALPHAS_1D))}])::DOUBLE AS a) GROUP BY a)"
_XY = "w AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')"


def _xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), "l_shipdate")


@query("ridge_1d_closed_form", f"WITH {_XY}, {_RIDGE_1D} SELECT alpha, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept FROM r")
def ridge_1d_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ridge.closed_form(_xy(spark, sf_dir).where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")), "x", "y", ALPHAS_1D)
    return out.select("alpha", F.col("slope").alias("slope"), F.col("intercept").alias("intercept"))


@query(
    "alpha_tuning",
    f"""WITH {_XY}, f AS (SELECT a AS alpha, covar_pop(x, y) * count(*) / (count(*) + a) / var_pop(x) AS slope, avg(y) AS my, avg(x) AS mx FROM w, (SELECT unnest([{", ".join(map(str, ridge.ALPHAS))}])::DOUBLE AS a) GROUP BY a),
v AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '2000-01-01'),
m AS (SELECT alpha, avg(abs(y - (my + slope * (x - mx)))) AS mae, sqrt(avg((y - (my + slope * (x - mx))) * (y - (my + slope * (x - mx))))) AS rmse FROM f, v GROUP BY 1)
SELECT alpha, round(mae, 6) AS mae, round(rmse, 6) AS rmse, row_number() OVER (ORDER BY round(mae, 2), alpha) = 1 AS chosen FROM m""",
)
def alpha_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid from one set of sums and one pass over the validation rows; the least MAE is chosen, the earliest of equals."""
    train, validation, _ = splits.time_split(_xy(spark, sf_dir), "l_shipdate", TRAIN_UNTIL, VALIDATION_UNTIL)
    best, rows = ridge.tune(train, validation, "y", ridge.ALPHAS, numeric=["x"])
    return spark.createDataFrame([(a, m, r, a == best) for a, m, r in rows], "alpha double, mae double, rmse double, chosen boolean")


_HOUR_DOW = one_hot("hour_dow", [f"{h}_{d}" for h in range(24) for d in range(7)])
_PIPELINE = "(SELECT 0 AS model, *, epoch(hour_ts) / 86400 AS t, hour || '_' || day_of_week AS hour_dow FROM hours WHERE hour_ts {cut})"


@query(
    "ridge_pipeline_metrics",
    f"""WITH RECURSIVE {HOURS}, {solved("s", _PIPELINE.format(cut=f"< TIMESTAMP '{CUT}'"), _PIPELINE.format(cut=f">= TIMESTAMP '{CUT}'"), ["t"], [*_HOUR_DOW, *one_hot("month", list(range(1, 13))), "day_of_week >= 5"], 10.0)}
SELECT count(pred - y) AS n, round(avg(abs(y - pred)), 6) AS mae, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round(1 - avg((y - pred) * (y - pred)) / nullif(var_pop(y), 0), 6) AS r2 FROM s""",
)
def ridge_pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hours(spark, sf_dir).withColumn("t", (F.unix_timestamp(F.col("hour_ts").cast("timestamp")) / 86400).cast("double"))
    cut = F.lit(CUT).cast("timestamp_ntz")
    model = ridge.fit(df.where(F.col("hour_ts") < cut), "y", ["t"], ["hour_dow", "month"], ["is_weekend"], alpha=10.0)
    return metrics(model.predict(df.where(F.col("hour_ts") >= cut)))


@query("log_target_probe", "SELECT event_type, round(exp(avg(ln(1 + value))) - 1, 6) AS back FROM events WHERE value > -1 GROUP BY 1")
def log_target_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("value > -1").groupBy("event_type").agg(F.expm1(F.avg(F.log1p("value"))).alias("back"))


@query(
    "row_fingerprint",
    "WITH h AS (SELECT ('0x' || substr(md5(epoch_us(ts)::VARCHAR), 1, 15))::BIGINT::HUGEINT AS x FROM events WHERE ts IS NOT NULL) SELECT substr(sha1(count(*) || '/' || coalesce(sum(x), 0)), 1, 12) AS fingerprint, count(*) AS n FROM h",
)
def row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.row_fingerprint(events(spark, sf_dir), "ts")


# --- scoring --------------------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of events: some outside the ranges, some with labels that do not exist."""
    e = events(spark, sf_dir).where("ts is not null")
    k = F.col("event_id")
    weather = F.when(k % 7 == 0, F.array(F.lit("Rain"), F.lit("Snow"))).when(k % 7 == 1, F.array(F.lit("Hail"))).when(k % 7 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("Clouds"), F.lit("Clear"), F.lit("Clouds")))
    return e.select(
        k.alias("request_id"), F.col("ts").alias("date_time"), (F.col("value") - 40).alias("temperature_celsius"), F.when(k % 3 == 0, F.lit(0.0)).when(k % 3 == 1, F.col("value")).alias("rain_1h_mm"),
        F.when(k % 2 == 0, F.lit(0.0)).alias("snow_1h_mm"), (k % 120).cast("int").alias("clouds_all"), weather.alias("weather"), F.when(k % 11 == 0, F.make_date(F.lit(2023), F.lit(8), F.lit(24))).when(k % 11 == 1, F.to_date("ts")).alias("state_fair_start_date"),
    )


@query(
    "score_requests",
    f"""WITH q AS (SELECT event_id AS k, ts, value - 40 AS t, CASE event_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN value END AS rain, CASE WHEN event_id % 2 = 0 THEN 0.0::DOUBLE END AS snow, event_id % 120 AS clouds, event_id % 7 AS w, event_id % 11 AS f FROM events WHERE ts IS NOT NULL),
r AS (SELECT *, concat_ws(',', CASE WHEN t NOT BETWEEN -70 AND 70 THEN 'temperature_celsius:range' END, CASE WHEN rain NOT BETWEEN 0 AND 500 THEN 'rain_1h_mm:range' END, CASE WHEN clouds NOT BETWEEN 0 AND 100 THEN 'clouds_all:range' END,
    CASE WHEN w = 2 THEN 'weather:missing' END, CASE WHEN w = 1 THEN 'weather:unknown' END, CASE WHEN f = 0 THEN 'state_fair_start_date:other_year' END) AS errors,
  concat_ws(',', CASE WHEN ts NOT BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' THEN 'outside_range' END, 'state_fair_unknown', CASE WHEN rain IS NULL AND w = 0 THEN 'rain_missing_but_implied' WHEN rain IS NULL THEN 'rain_missing' END,
    CASE WHEN snow IS NULL AND w = 0 THEN 'snow_missing_but_implied' WHEN snow IS NULL THEN 'snow_missing' END) AS warnings,
  CASE WHEN f = 1 THEN 'State Fair' ELSE {C.holiday_sql("ts")} END AS holiday_name, CASE w WHEN 0 THEN 'snow' WHEN 1 THEN 'other' WHEN 2 THEN NULL ELSE 'partly_cloudy' END AS family, 3 * t + coalesce(rain, 0) AS raw FROM q)
SELECT k AS request_id, errors, warnings, holiday_name, family AS weather_family, CASE WHEN errors = '' THEN round(greatest(0.0::DOUBLE, raw), 6) END AS prediction, (errors = '' AND raw < 0) AS clipped FROM r""",
)
def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scoring.warnings(scoring.features(scoring.validate(_requests(spark, sf_dir))), "2024-01-05 00:00:00", "2024-01-25 00:00:00")
    out = scoring.respond(df.withColumn("raw_prediction", 3 * F.col("temperature_celsius") + F.coalesce("rain_1h_mm", F.lit(0.0))), {"policy_id": "non_negative_projection"})
    errors = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["code"])), ",")
    return out.select("request_id", errors.alias("errors"), F.array_join("warnings", ",").alias("warnings"), "holiday_name", "weather_family", F.col("prediction").alias("prediction"), "clipped")


# --- windows (batch side of the streaming operators) ----------------------------------------------------------------


@query(
    "window_collapse",
    """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS b, * FROM events), c AS (SELECT b, event_type AS p, count(*) AS n FROM w GROUP BY ALL), m AS (SELECT b, p, row_number() OVER (PARTITION BY b ORDER BY n DESC, p) AS k FROM c)
SELECT w.b AS start, w.b + INTERVAL 6 HOUR AS "end", count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(sum(value), 4) AS total, any_value(m.p) AS label_mode, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS label_set FROM w JOIN m ON m.b = w.b AND k = 1 GROUP BY w.b""", digits={"total": 4})
def window_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.streaming.windows import collapse_windows

    out = collapse_windows(events(spark, sf_dir), "ts", "6 hours", "event_type", "value")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    "session_windows",
    """WITH l AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""", digits=4)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.streaming.windows import sessions

    out = sessions(events(spark, sf_dir).where("ts is not null"), "ts", "4 hours", "user_id", "value")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
