import random
from pathlib import Path

import pytest

from tidemark.llm.common import clear, components, materialise, new_folder, shared_dir


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("kind", ["path", "star", "random", "cycle", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "path": [(i, i + 1) for i in range(60)], "star": [(7, i) for i in range(100, 400)] + [(500, 501)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)],
        "cycle": [(i, (i + 1) % 30) for i in range(30)] + [(100, 100)], "none": [],
    }[kind]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges + edges[:3], "a long, b long")).collect()}
    want = brute([(a, b) for a, b in edges if a != b])
    assert got == want


def test_stored_tables_keep_schema_and_can_be_cleared(spark):
    df = spark.createDataFrame([], "a long, b array<string>")
    again = materialise(spark, df, "t")
    assert again.schema == df.schema and again.collect() == []
    folder = Path(new_folder(spark, "").removeprefix("file://")).parent
    assert folder.exists() and shared_dir(spark).startswith("file://")
    clear(spark)
    assert not folder.exists()
