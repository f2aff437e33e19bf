"""Every query against its SQL on DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark import registry

SF = Path("/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in SF.iterdir():
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9f}"
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    rel = con.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=str)
    kinds = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema}
    assert kinds == dict(zip(rel.columns, map(str, rel.types), strict=True))
