"""Every query of the library (the llm subpackage keeps its own) and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import baseline, catalogue, studies  # noqa: F401  (studies adds its queries to those of the catalogue)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (baseline, catalogue):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
