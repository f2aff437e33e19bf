import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import substrings as s


def brute(texts, window):
    """(words, removed, kept) of each text: windows are counted as tuples of words."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def run(spark, texts, window, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(s.substring_dedup(df, window=window, **more).collect(), key=lambda r: r.doc_id)
    for r in got:
        assert sum(x.length for x in r.spans) == r.n_removed and all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))
    return [(r.n_words, r.n_removed, r.kept) for r in got]


def corpus(seed, window, n=80):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 400)}"
    passages = [[word() for _ in range(rng.randrange(window - 3, 3 * window))] for _ in range(8)]
    out = [None, "", "  \n\t ", "one"]
    while len(out) < n:
        words = [word() for _ in range(rng.randrange(0, 4 * window))]
        for _ in range(rng.randrange(3)):
            passage = rng.choice(passages)
            a = rng.randrange(0, 6)
            k = rng.randrange(len(words) + 1)
            words[k:k] = passage[a : len(passage) - rng.randrange(0, 6)]
        out += [" ".join(words)] * rng.choice([1, 1, 1, 2, 5])
        if rng.random() < 0.3 and words:  # a near copy
            words[rng.randrange(len(words))] = "changed"
            out.append("\n".join(words))
    return out


@pytest.mark.parametrize(("seed", "window", "gathered"), [(1, 35, 2_000_000), (2, 35, 400), (3, 10, 50), (4, 2, 2_000_000)])
def test_equals_brute_force(spark, seed, window, gathered):
    texts = corpus(seed, window)
    got = run(spark, texts, window, gathered=gathered)
    assert got == brute(texts, window)
    assert any(0 < r < n for n, r, _ in got) and any(r == 0 < n for n, r, _ in got)


def test_a_text_that_repeats_itself_and_one_shared_passage_in_many(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    texts = ["x " * 300, " ".join(f"u{i}" for i in range(200))] + [f"{' '.join(f'a{k}_{i}' for i in range(k % 50))} {shared} b{k} c{k}" for k in range(200)]
    got = run(spark, texts, 35, gathered=3000)
    assert got == brute(texts, 35)
    assert got[0][1] == 300 and got[1][1] == 0 and all(r == 40 for _, r, _ in got[2:])


def test_long_texts(spark):
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 300_000)]
    texts = [" ".join(words), " ".join(words[100_000:100_050]), "y" * 3_000_000, "q " + "y" * 3_000_000]
    got = run(spark, texts, 35)
    assert [r for _, r, _ in got] == [50, 50, 0, 0]


def test_empty_tables_null_ids_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert s.substring_dedup(empty).collect() == [] and s.substring_dedup(empty).columns == ["doc_id", "text", "n_words", "n_removed", "spans", "kept"]
    text = " ".join(f"w{i}" for i in range(36))
    rows = [(None, text, "k", 1, "r"), (None, text + " end", "k", 2, "r"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, kept int, row string")
    got = s.substring_dedup(df)
    assert got.columns == ["doc_id", "text", "key", "row", "n_words", "n_removed", "spans", "kept"]
    assert sorted((r.key or "", r.row or "", r.n_words, r.n_removed, r.kept) for r in got.collect()) == [("", "", 0, 0, ""), ("k", "r", 36, 36, ""), ("k", "r", 37, 36, "end")]


def test_rolling_hashes_depend_on_all_words_and_their_order():
    words = [b"a", b"b", b"c", b"d", b"a", b"b", b"c", b"e", b"b", b"a"]
    got = s.rolling(s.word_hashes(words)[:, 0], 3)
    assert len(got) == 8 and got[0] == got[4] and len(set(got.tolist())) == 7
    assert len(s.rolling(s.word_hashes(words)[:, 0], 11)) == 0
