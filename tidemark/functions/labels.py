"""Weather labels: fixed rule tables, slugs, families, severities and set strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The main labels, and how severe each is. Unknown labels have UNKNOWN_SEVERITY.
MAIN_SEVERITY = {
    "Clear": 0,
    "Clouds": 1,
    "Drizzle": 2,
    "Fog": 2,
    "Haze": 1,
    "Mist": 2,
    "Rain": 3,
    "Smoke": 3,
    "Snow": 3,
    "Squall": 4,
    "Thunderstorm": 4,
}
UNKNOWN_SEVERITY = 2

#: A description's family is that of the first of these words in it, in this order.
FAMILY_WORDS = (
    ("thunder", "thunder"),
    ("squall", "thunder"),
    ("rain and snow", "mixed_precip"),
    ("shower snow", "mixed_precip"),
    ("sleet", "mixed_precip"),
    ("freezing", "mixed_precip"),
    ("snow", "snow"),
    ("drizzle", "rain"),
    ("shower", "rain"),
    ("rain", "rain"),
    ("fog", "fog"),
    ("mist", "mist"),
    ("haze", "haze_smoke"),
    ("smoke", "haze_smoke"),
    ("overcast", "overcast"),
    ("cloud", "partly_cloudy"),
    ("clear", "clear"),
)

#: Families by severity.
FAMILY_SEVERITY = {
    "clear": 0,
    "partly_cloudy": 1,
    "overcast": 2,
    "haze_smoke": 3,
    "mist": 4,
    "fog": 5,
    "rain": 6,
    "snow": 7,
    "mixed_precip": 8,
    "thunder": 9,
    "other": 2,
}

#: The family that a main label stands for when there is no description.
FAMILY_OF_MAIN = {
    "Clear": "clear",
    "Clouds": "partly_cloudy",
    "Drizzle": "rain",
    "Fog": "fog",
    "Haze": "haze_smoke",
    "Mist": "mist",
    "Rain": "rain",
    "Smoke": "haze_smoke",
    "Snow": "snow",
    "Squall": "thunder",
    "Thunderstorm": "thunder",
}

EXTREME = ("Snow", "Thunderstorm", "Squall")


def slug(c: Column) -> Column:
    """Lower case; runs that are neither letters nor digits become one underscore, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^0-9a-zA-Z]+", "_"), "^_+|_+$", ""))


def slug_of(text: str) -> str:
    """The same for a name on the driver."""
    return "_".join(re.findall("[0-9a-z]+", text.lower()))


def main_columns(categories=tuple(MAIN_SEVERITY), prefix: str = "wm") -> list[str]:
    """Names of the multi-hot columns."""
    return [f"{prefix}_{slug_of(c)}" for c in categories]


def first_keyword(text: Column, words=FAMILY_WORDS, other: str = "other") -> Column:
    """The value of the first of the words that the trimmed lower-case text contains; null and empty texts are other."""
    low, out = F.lower(F.trim(text)), F.lit(other)
    for word, value in reversed(words):
        out = F.when(F.instr(low, word) > 0, value).otherwise(out)
    return out


def severity(c: Column, table: dict[str, int], unknown: int = UNKNOWN_SEVERITY) -> Column:
    scale = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(scale, c), F.lit(unknown))


def set_string(c: Column) -> Column:
    """Sorted distinct values joined by '; ' (an aggregate)."""
    return F.array_join(F.sort_array(F.collect_set(c)), "; ")


def split_set(c: Column) -> Column:
    return F.split(c, "; ")


def family_of_labels(labels: Column) -> Column:
    """The most severe family of an array of main labels; a tie goes to the later name. Null for an empty array."""
    name = F.create_map(*(F.lit(x) for kv in FAMILY_OF_MAIN.items() for x in kv))
    pairs = F.transform(labels, lambda x: F.struct(severity(F.coalesce(F.try_element_at(name, x), F.lit("other")), FAMILY_SEVERITY).alias("s"), F.coalesce(F.try_element_at(name, x), F.lit("other")).alias("f")))
    return F.array_max(pairs)["f"]
