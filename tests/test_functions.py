from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as C
from tidemark.functions import labels as L
from tidemark.functions import numbers as N


def calendar_of(year):
    """The rules once more, by walking the days of a year."""
    days = [date(year, 1, 1) + timedelta(i) for i in range(366) if (date(year, 1, 1) + timedelta(i)).year == year]
    pick = lambda m, w: [d for d in days if d.month == m and d.weekday() == w]

    def seen(m, d):
        day = date(year, m, d)
        return day - timedelta(1) if day.weekday() == 5 else day + timedelta(1) if day.weekday() == 6 else day

    out = {
        seen(1, 1): "New Years Day", pick(1, 0)[2]: "Martin Luther King Jr Day", pick(2, 0)[2]: "Washingtons Birthday", pick(5, 0)[-1]: "Memorial Day", seen(7, 4): "Independence Day",
        pick(9, 0)[0]: "Labor Day", pick(10, 0)[1]: "Columbus Day", seen(11, 11): "Veterans Day", pick(11, 3)[3]: "Thanksgiving Day", seen(12, 25): "Christmas Day",
    }
    if year in C.STATE_FAIR:
        out[date.fromisoformat(C.STATE_FAIR[year])] = "State Fair"
    return {d: out.get(d, "None") for d in days}


def test_holidays_of_three_centuries(spark):
    df = spark.sql("SELECT explode(sequence(DATE'1900-01-01', DATE'2200-12-31', INTERVAL 1 DAY)) AS d")
    got = {r.d: r.h for r in df.select("d", C.holiday_name(F.col("d")).alias("h")).collect()}
    want = {}
    for y in range(1900, 2201):
        want |= calendar_of(y)
    assert got == want


def test_a_saturday_new_year_is_observed_on_no_day(spark):
    df = spark.createDataFrame([(date(1999, 12, 31),), (date(2000, 1, 1),), (None,)], "d date")
    assert [r.h for r in df.select(C.holiday_name(F.col("d")).alias("h")).collect()] == ["None"] * 3


def test_nth_weekday_on_the_driver():
    assert C.nth_weekday_of_month(2024, 11, 3, 4) == date(2024, 11, 28)
    for n in (0, 6):
        with pytest.raises(ValueError):
            C.nth_weekday_of_month(2024, 2, 0, n)
    assert "State Fair" in C.known_holiday_names() and len(C.known_holiday_names()) == 11


def test_calendar_features(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-07 08:30:00' AS t")
    r = C.add_calendar_features(df, "t").first()
    assert (r.hour, r.day_of_week, r.month, r.year, r.is_weekend, r.hour_dow) == (8, 6, 1, 2024, 1, "8_6")


@pytest.mark.parametrize(
    "text,family",
    [("sky is Clear", "clear"), ("SQUALLS", "thunder"), ("light rain and snow", "mixed_precip"), ("shower snow", "mixed_precip"), ("heavy snow", "snow"), ("proximity shower rain", "rain"), ("overcast clouds", "overcast"), ("few clouds", "partly_cloudy"), (" Haze ", "haze_smoke"), ("thunderstorm with rain", "thunder"), ("dust", "other"), ("", "other"), (None, "other")],
)
def test_families(spark, text, family):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(L.first_keyword(F.col("x")).alias("f")).first().f == family


def test_slug_severity_and_sets(spark):
    df = spark.createDataFrame([("Thunderstorm  (x)",), ("--",), (None,)], "x string")
    assert [r[0] for r in df.select(L.slug(F.col("x"))).collect()] == ["thunderstorm_x", "", None]
    assert [L.slug_of(x) for x in ("Thunderstorm  (x)", "--")] == ["thunderstorm_x", ""]
    s = spark.createDataFrame([("Squall",), ("Hail",), (None,)], "x string").select(L.severity(F.col("x"), L.MAIN_SEVERITY).alias("s"))
    assert [r.s for r in s.collect()] == [4, 2, 2]
    f = spark.createDataFrame([(["Clear", "Snow", "Rain"],), (["Clouds", "Hail"],), ([],)], "x array<string>").select(L.family_of_labels(F.col("x")).alias("f"))
    assert [r.f for r in f.collect()] == ["snow", "other", None]
    assert len(L.main_columns()) == 11 and L.main_columns()[-1] == "wm_thunderstorm"


def test_numbers(spark):
    df = spark.createDataFrame([(1.0,), (-2.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(N.is_finite(F.col("x"))).collect()] == [True, True, False, False, False]
    assert [r[0] for r in df.limit(2).select(N.non_negative(F.col("x"))).collect()] == [1.0, 0.0]
    assert N.signature({"b": 1, "a": 2}) == N.signature({"a": 2, "b": 1}) != N.signature({"a": 2, "b": 1.5})
    with pytest.raises(ValueError):
        N.canonical_json({"a": float("nan")})


def test_fingerprint_knows_no_order(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-03', INTERVAL 1 HOUR)) AS t")
    a, b = N.row_fingerprint(df, "t").first(), N.row_fingerprint(df.orderBy(F.desc("t")).repartition(3), "t").first()
    assert a == b and len(a.fingerprint) == 12
    assert N.row_fingerprint(df.limit(40), "t").first().fingerprint != a.fingerprint
