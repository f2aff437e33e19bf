"""Date and time functions: calendar features, rule dates and the holiday calendar, all as column expressions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_HOLIDAY = "None"

#: The published opening days of the State Fair by year.
STATE_FAIR = {
    2012: "2012-08-23",
    2013: "2013-08-22",
    2014: "2014-08-21",
    2015: "2015-08-27",
    2016: "2016-08-25",
    2017: "2017-08-24",
    2018: "2018-08-23",
    2019: "2019-08-22",
    2020: "2020-08-21",
}

#: Fixed values: (name, kind, month, weekday or day, which). Monday is 0.
RULES = (
    ("New Years Day", "date", 1, 1, None),
    ("Martin Luther King Jr Day", "nth", 1, 0, 3),
    ("Washingtons Birthday", "nth", 2, 0, 3),
    ("Memorial Day", "last", 5, 0, None),
    ("Independence Day", "date", 7, 4, None),
    ("Labor Day", "nth", 9, 0, 1),
    ("Columbus Day", "nth", 10, 0, 2),
    ("Veterans Day", "date", 11, 11, None),
    ("Thanksgiving Day", "nth", 11, 3, 4),
    ("Christmas Day", "date", 12, 25, None),
)


def is_nth_weekday(day: Column, month: int, weekday: int, n: int) -> Column:
    """Whether a date is the n-th such weekday of the month."""
    if n < 1 or n > 5:
        raise ValueError("n must be 1 to 5")
    return (F.month(day) == month) & (F.weekday(day) == weekday) & (F.floor((F.dayofmonth(day) - 1) / 7) + 1 == n)


def is_last_weekday(day: Column, month: int, weekday: int) -> Column:
    return (F.month(day) == month) & (F.weekday(day) == weekday) & (F.dayofmonth(day) + 7 > F.dayofmonth(F.last_day(day)))


def is_observed(day: Column, month: int, on: int) -> Column:
    """Whether a date is the observed day of a fixed date: the Friday before a Saturday, the Monday after a Sunday.

    A year's calendar is looked up by the date's own year, so a 1 January that falls on a Saturday is observed on no day.
    """
    w, d = F.weekday(day), F.dayofmonth(day)
    shifted = (d == on) & (w < 5) | (d == on + 1) & (w == 0)
    return (F.month(day) == month) & (shifted | (d == on - 1) & (w == 4))


def nth_weekday_of_month(year: int, month: int, weekday: int, n: int) -> date:
    """The date itself, on the driver; ValueError if the month has none."""
    if n < 1:
        raise ValueError("n must be at least 1")
    first = date(year, month, 1)
    day = first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    if day.month != month:
        raise ValueError(f"{year}-{month:02d} has no such weekday number {n}")
    return day


def holiday_name(day: Column) -> Column:
    """The holiday that a date is, by rule alone; 'None' for all others and for null."""
    out = F.lit(NO_HOLIDAY)
    for name, kind, month, a, n in reversed(RULES):
        hit = {"nth": lambda: is_nth_weekday(day, month, a, n), "last": lambda: is_last_weekday(day, month, a), "date": lambda: is_observed(day, month, a)}[kind]()  # noqa: B023
        out = F.when(hit, name).otherwise(out)
    return F.when(day.isin(*(F.lit(d).cast("date") for d in STATE_FAIR.values())), "State Fair").otherwise(out)


def is_year_known(year: Column) -> Column:
    """Whether the table of State Fair days covers a year; the other holidays are rules for all years."""
    return year.isin(*STATE_FAIR)


def known_holiday_names() -> list[str]:
    return sorted({"State Fair", *(r[0] for r in RULES)})


def holiday_sql(d: str) -> str:
    """The same as a CASE for other engines with isodow()."""
    w, k = f"(isodow({d}) - 1)", f"((day({d}) - 1) // 7 + 1)"
    whens = ["WHEN CAST(" + d + " AS DATE) IN (" + ", ".join(f"DATE '{x}'" for x in STATE_FAIR.values()) + ") THEN 'State Fair'"]
    for name, kind, month, a, n in RULES:
        if kind == "nth":
            hit = f"month({d}) = {month} AND {w} = {a} AND {k} = {n}"
        elif kind == "last":
            hit = f"month({d}) = {month} AND {w} = {a} AND day({d}) + 7 > day(last_day({d}))"
        else:
            hit = f"month({d}) = {month} AND ((day({d}) = {a} AND {w} < 5) OR (day({d}) = {a} + 1 AND {w} = 0) OR (day({d}) = {a} - 1 AND {w} = 4))"
        whens.append(f"WHEN {hit} THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE '{NO_HOLIDAY}' END"


def add_calendar_features(df: DataFrame, time_col: str) -> DataFrame:
    """hour, day_of_week (Monday 0), month, year, is_weekend and hour_dow."""
    t = F.col(time_col)
    return df.withColumns({
        "hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t), "year": F.year(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"), "hour_dow": F.concat_ws("_", F.hour(t), F.weekday(t)),
    })


def add_holiday_flag(df: DataFrame, time_col: str) -> DataFrame:
    """is_holiday and holiday_name for the whole day, from the calendar and not from any column."""
    day = F.to_date(F.col(time_col))
    return df.withColumn("holiday_name", holiday_name(day)).withColumn("is_holiday", (F.col("holiday_name") != NO_HOLIDAY).cast("int"))
