import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M
from tidemark.llm import packing

SCHEMA = "doc_id long, text string, source string, size string, target int, id string, key double, slice int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "y", 0.0, 1) for i, t, s in rows], SCHEMA)


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(["a", "B", "é", "z" * 3, None, "hot", "hot", "hot"])
        rows.append((i, " ".join("w###" if rng.random() < 0.3 else "w" for _ in range(rng.randrange(80))), s))
    return rows


def reshared(sizes, share=1.5, most=2.0):
    """The contract step by step: share by weight, stop at the limit, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and free:
        per = left / sum(weight[s] for s in free)
        left = 0.0
        for s in sorted(free, key=str):
            target[s] += per * weight[s]
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
        free = {s for s in free if target[s] < most * sizes[s]}
    return target


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_targets_and_taken(spark, seed):
    rows = corpus(seed=seed) + [(None, "q w e", "a"), (None, "q w e", "a"), (900, None, "a"), (901, "", "empty"), (902, "solo", None)]
    out = M.mix(frame(spark, rows), slice_bits=4, end_rows=5).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = reshared(dict(sizes))
    taken, largest = collections.Counter(), collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


@pytest.mark.parametrize("slice_bits,end_rows", [(3, 2), (10, 1), (25, 10**9), (7, 1)])
def test_equals_sql_and_does_not_depend_on_slices(spark, slice_bits, end_rows):
    rows = corpus(300, 5)
    a = sorted(M.mix(frame(spark, rows)).select("id", "size", "source_size", "target", "taken").collect())
    b = sorted(M.mix(frame(spark, rows).repartition(7), slice_bits=slice_bits, end_rows=end_rows).select("id", "size", "source_size", "target", "taken").collect())
    assert a == b
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [list(r) for r in rows])
    want = sorted(con.sql(M.OP3_SQL).fetchall())
    assert [(*r[:3], r[4]) for r in want] == [(r.id, r["size"], r.source_size, r.taken) for r in a]
    assert [r[3] for r in want] == pytest.approx([r.target for r in a])


def test_better_documents_are_taken_more(spark):
    rows = [(i, " ".join(["w"] * 20 if i % 2 else ["w"] * 16 + ["#####"] * 4), "few") for i in range(600)] + [(10**6, "w " * 200000, "aa")]
    out = M.mix(frame(spark, rows)).where("source = 'few'")
    got = {r.odd: r.n for r in out.groupBy((F.col("id") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()}
    assert got[1] >= got[0]


def test_empty_table_and_only_empty_texts(spark):
    assert M.mix(frame(spark, [])).collect() == []
    out = M.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2


def test_no_python_in_the_plan(spark):
    plan = M.mix(frame(spark, corpus(20)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stage_repeats_rows(spark):
    docs = spark.createDataFrame([(i, "w " * 30, "en", s, 60) for i, s in enumerate("aabbbbbbbb")], "doc_id long, text string, lang string, source string, n_chars long")
    out = M.stage_mixing(spark, docs, "")
    assert out.schema.names == docs.schema.names
    counts = collections.Counter(r.doc_id for r in out.collect())
    assert max(counts.values()) <= 2 and sum(counts.values()) == 15


def test_stage_keeps_rows_without_an_id(spark):
    rows = [(None if i % 2 else i, f"w{i} " * (20 + i % 7), "en", s, 60) for i, s in enumerate("aabbbbbbbbb" * 4 + "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = M.stage_mixing(spark, docs, "")
    assert out.schema.names == docs.schema.names
    got, want = collections.Counter(), collections.Counter()
    for r in out.collect():
        got[r.doc_id is None, r.source] += len(r.text.split())
    for r in M.mix(docs).collect():
        want[r.id is None, r.source] += r.taken
    assert got == +want and got[True, "b"] > 0
    assert packing.stage_packing(spark, out, "").where("doc_id is null").count() > 0


def test_only_few_documents_are_sorted_however_keys_crowd(spark, monkeypatch):
    """Documents of the least quality have keys ten times as far out: the slice where the budget ends is cut again."""
    rows = [(i, "#### " * 10, "junk") for i in range(3000)] + [(10**6, "w " * 4000, "aa")]
    seen = []
    real = M.materialise
    monkeypatch.setattr(M, "materialise", lambda spark, df, name, *a: (seen.append((name, real(spark, df, name, *a))), seen[-1][1])[1])
    out = M.mix(frame(spark, rows), slice_bits=2, end_rows=40)
    got = out.agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).first()
    assert got.n == len(rows)
    last = [df for name, df in seen if name == "ends"][-1].collect()
    assert all(r.end_rows <= 40 for r in last) and {r.left for r in last} != {48}
    want = M.mix(frame(spark, rows), end_rows=10**9).agg(F.sum("taken").alias("taken")).first()
    assert got.taken == want.taken


def test_stage_decides_row_by_row(spark):
    """Null ids, shared ids and columns that bear the names used inside: each row as often as mix() says of a row like it."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _copies string, _row int, key double, extra string"
    rows = [(None, "a b c d", "en", "s", 1), (1, "a b c d e", "en", "s", 2), (1, "v w x y z q", "en", "s", 3), (2, "a b c d e f", None, None, None), (None, None, None, "s", 5), (3, "", "en", "t", 6)]
    docs = spark.createDataFrame([(*r, "c", 1, 0.5, None) for r in rows], schema)
    out = M.stage_mixing(spark, docs, "")
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text, r.source) for r in out.collect())
    want = collections.Counter()
    for r in M.mix(docs, carry=True).collect():
        want[r._row.doc_id, r._row.text, r._row.source] += r.epochs + r.extra if r["size"] else 0
    assert got == +want and sum(got.values()) > 3
