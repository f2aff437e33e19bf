import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic as p


def brute(words):
    """By definition: every maximal stretch of each period, its smallest period found by trying all smaller ones."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(6, 4 * q) and not any(all(words[k] == words[k + r] for k in range(start, end - r)) for r in range(1, q)):
                out.append((start, end - start, q))
            i = j + 1
    return sorted(out)


def brute_collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]


def number(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


blocks = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2), max_size=60), blocks.map(lambda bs: [x for b, k in bs for x in b * k])))
def test_runs_equal_brute_force(words):
    got = p.find_runs(number(words))
    assert got == brute(words)
    as_bytes = [b"%d" % w for w in words]
    assert p.collapse(as_bytes, got) == b" ".join(brute_collapse(as_bytes, got))


@pytest.mark.parametrize("n", [3, 50, 700, 3000])
def test_lag_counts_of_heavy_and_light_words(n):
    rng = np.random.default_rng(n)
    ids = np.unique((rng.pareto(0.7, n)).astype(np.int64), return_inverse=True)[1]
    most = n // 4
    want = [0] + [int((ids[:-q] == ids[q:]).sum()) for q in range(1, most + 1)]
    assert p.lag_matches(ids, most).tolist() == want


def test_long_periods_are_found_by_steps():
    rng = random.Random(5)
    words = [rng.randrange(50) for _ in range(300)]
    block = [rng.randrange(50) for _ in range(97)]
    words += (block * 6)[: 97 * 5 + 13] + [rng.randrange(50) for _ in range(200)]
    assert p.find_runs(number(words)) == brute(words)


def test_long_texts_take_seconds():
    began = time.time()
    same = np.zeros(1_000_000, np.int64)
    assert p.find_runs(same) == [(0, 1_000_000, 1)]
    coins = np.random.default_rng(1).integers(0, 2, 200_000)
    assert all(length >= max(6, 4 * q) for _, length, q in p.find_runs(coins))
    text = np.minimum(np.random.default_rng(2).zipf(1.3, 500_000), 60_000)
    text = np.concatenate([text, np.tile(text[:50_000], 5)])
    got = p.find_runs(np.unique(text, return_inverse=True)[1])
    assert any(q == 50_000 and length >= 250_000 for _, length, q in got)
    assert time.time() - began < 60


def test_rows_of_every_kind(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, " \t\n ", "y"), (2, "a " * 7, None), (2, "a " * 7, None), (3, "é é b " * 4, "z"), (4, "one two three", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = p.periodic_runs(df).collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (0, [], ""), (0, [], ""), (0, [], ""), (7, [(0, 7, 1)], "a"), (7, [(0, 7, 1)], "a"), (8, [(0, 8, 2)], "é é b"), (3, [], "one two three"),
    ]
    assert p.periodic_runs(df.limit(0)).collect() == []
    assert p.op11_periodic_runs.__module__ == p.__name__


def expect(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, q = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % q] for i, w in enumerate(words)]
    runs = brute(words)
    s = length = q = None
    if runs:
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    return (doc_id, len(runs), s, length, q, 1000 * length // q if q else None, sha(lines), sha(b" ".join(brute_collapse(words, runs))))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, None if i % 37 == 0 else " ".join(rng.choice(["the", "a", "b\n", "café", "x\t"]) for _ in range(rng.choice([0, 1, 40, 150])))) for i in range(500)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in p.op11_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted(expect(*r) for r in rows)
    assert sum(r[2] is not None for r in got) > 10
