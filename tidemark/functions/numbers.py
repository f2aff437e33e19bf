"""Numeric functions: clips, checks, temperatures, logarithms, fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int = 6) -> Column:
    """For reports and queries only: operators return what they computed."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def round_doubles(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Every double column rounded, to the digits that are given for all or for each."""
    at = lambda name: digits.get(name, 6) if isinstance(digits, dict) else digits
    return df.withColumns({f.name: rounded(f"`{f.name}`", at(f.name)) for f in df.schema.fields if f.dataType.simpleString() == "double"})


def non_negative(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def is_finite(c: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), F.lit(False))


def celsius_to_kelvin(c: Column) -> Column:
    return c + 273.15


def row_fingerprint(df: DataFrame, time_col: str) -> DataFrame:
    """One row: 12 hex characters that identify a set of timestamps, whatever their order.

    Each timestamp is hashed on its own and the hashes are summed in exact decimals, so no task gathers them all.
    """
    part = F.conv(F.substring(F.md5(F.unix_micros(F.col(time_col).cast("timestamp")).cast("string").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)"))
    return df.where(F.col(time_col).isNotNull()).agg(F.substring(F.sha1(F.concat_ws("/", F.count("*"), total).cast("binary")), 1, 12).alias("fingerprint"), F.count("*").alias("n"))


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))


def signature(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
