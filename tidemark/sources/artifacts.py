"""Small artifacts on the driver: JSON, Markdown, models and idempotent writes; checksums through Spark."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ridge import Ridge


def read_json(path: str | Path) -> object | None:
    """The document, or None where the file is missing or no JSON."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None


def write_if_changed(path: str | Path, text: str) -> bool:
    """Writes unless the file holds these very bytes; whether it wrote."""
    path, data = Path(path), text.encode()
    if path.exists() and path.read_bytes() == data:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return True


def write_json(path: str | Path, value: object) -> bool:
    """NaN and the infinities are refused: they are no JSON."""
    return write_if_changed(path, json.dumps(value, indent=2, sort_keys=True, allow_nan=False, default=str) + "\n")


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON objects, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def markdown(title: str, df: DataFrame, digits: int = 2) -> str:
    """A report's table of a small result."""
    show = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in df.collect())]) + "\n"


def sha256_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file, for files that fit in memory one by one."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_sha256(spark: SparkSession, path: str, expected: str) -> None:
    found = [r.sha256 for r in sha256_of(spark, path).collect()]
    if found != [expected]:
        raise ValueError(f"{path}: SHA-256 is {found}, not {expected}")


def save_model(path: str | Path, model: Ridge) -> bool:
    """The whole model: medians, means, scales, levels, weights. Full precision, so that what is loaded predicts the same."""
    return write_json(path, model.to_dict())


def load_model(path: str | Path) -> Ridge:
    found = read_json(path)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no model")
    return Ridge.from_dict(found)


def rounded_values(value: object, digits: int = 4) -> object:
    """A document with its floats rounded, at any depth; the infinities and NaN become null."""
    if isinstance(value, float):
        return round(value, digits) if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: rounded_values(v, digits) for k, v in value.items()}
    return [rounded_values(v, digits) for v in value] if isinstance(value, list | tuple) else value


def report(title: str, sections: list[tuple[str, str | DataFrame]], digits: int = 2) -> str:
    """A Markdown report: a heading and its paragraph or table for each section."""
    parts = [f"# {title}\n"]
    for name, body in sections:
        parts.append(f"## {name}\n\n{body}\n" if isinstance(body, str) else markdown(name, body, digits))
    return "\n".join(parts)
