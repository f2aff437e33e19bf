import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import quality_classifier as C
from tidemark.llm import quality_rules as R
from tidemark.llm import trees
from tidemark.llm.textstats import BASE, statistics

SCHEMA = "doc_id long, text string, kept string, features int, score string"


def brute(text):
    white = " \t\n\r\x0b\x0c"
    words, word = [], ""
    for c in text + " ":
        if c in white:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(white):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


TEXTS = ["", " \n\n", "a", "a b", "a b c", "a b c a b c", "x\nx\n \nx \n\n", "é ü #*$ |<>&%", "a a a a a", "one\ttwo\x0bthree\x0cone two three", "l " * 70000]


@pytest.mark.parametrize("text", TEXTS)
def test_statistics_of_edges(text):
    assert statistics(text.encode())[0] == brute(text)


def test_statistics_of_random_texts():
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", " ", "#", "ab "]) for _ in range(rng.randrange(120)))
        assert statistics(text.encode())[0] == brute(text)


def labelled(spark, n=300):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        text = " ".join(x + "***" if bad and rng.random() < 0.6 else x for x in w)
        docs.append((i, text, "no", 1, "z"))
        labels.append((i, int(not bad), None))
    labels += [(None, 1, 0), (3, None, 0), (5, 7, 0), (10**6, 1, 1)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def odd(spark):
    return spark.createDataFrame([(None, "a b", "", 1, ""), (1, None, "", 1, ""), (2, "", "", 1, ""), (2, "", "", 1, ""), (3, "l " * 70000, "", 1, "")], SCHEMA)


def test_rules(spark):
    docs, labels, y = labelled(spark)
    model = R.fit(docs, labels)
    out = {r.id: r for r in R.quality_rules(docs, model).collect()}
    assert np.mean([out[i].kept == bool(q) for i, q, _ in y[:300]]) > 0.97
    rows = R.quality_rules(odd(spark), model).collect()
    assert len(rows) == 5 and all(r.base_failed and not r.kept for r in rows)
    assert [rows[0][c] for c in BASE] == brute("a b")
    assert R.quality_rules(docs.limit(0), model).collect() == []


def test_no_labels_leaves_the_base_rules(spark):
    docs, labels, _ = labelled(spark, 40)
    model = R.fit(docs, labels.limit(0))
    assert all(r.kept != r.base_failed for r in R.quality_rules(docs, model).collect())
    ranking = C.fit(docs, labels.limit(0))
    assert {round(r.score, 6) for r in C.quality_scores(docs, ranking).collect()} == {0.5}


def test_sample_is_bounded(spark):
    docs, labels, _ = labelled(spark)
    x, y = R.labelled_sample(docs, labels, "quality", 50)
    assert len(x) == len(y) == 50


def test_trees_respect_constraints_and_flat_nodes_equal_sql(spark):
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (np.sin(9 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.3, 800) > 0.7).astype(float)
    free, bound = trees.fit(x, y), trees.fit(x, y, {0: 1, 1: -1})
    grid = np.tile(rng.random((50, 1, 3)), (1, 100, 1))
    for f, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, :, f] = np.linspace(0, 1, 100)
        steps = np.diff(bound.raw(g.reshape(-1, 3)).reshape(50, 100), axis=1) * sign
        assert steps.min() >= -1e-12
    assert ((free.probability(x) > 0.5) == y).mean() > 0.85
    small = trees.fit(x, y, n_trees=5)
    df = spark.createDataFrame(x[:50].tolist(), "a double, b double, c double").selectExpr(f"{small.sql(['a', 'b', 'c'])} as s")
    assert np.allclose([r.s for r in df.collect()], small.raw(x[:50]))


def test_classifier(spark):
    docs, labels, y = labelled(spark)
    model = C.fit(docs, labels)
    out = {r.id: r.score for r in C.quality_scores(docs, model).collect()}
    test = [(i, q) for i, q, _ in y[:300] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= C.THRESHOLD) == bool(q) for i, q in test]) > 0.95
    assert len(C.quality_scores(odd(spark), model).collect()) == 5
    assert all(0 <= r.score <= 1 for r in C.quality_scores(odd(spark), model).collect())


def test_held_out_labels_are_never_learned(spark):
    docs, labels, y = labelled(spark)
    flipped = [(i, 1 - q if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and q in (0, 1) else q, t) for i, q, t in y]
    other = spark.createDataFrame(flipped, labels.schema)
    a, b = C.fit(docs, labels), C.fit(docs, other)
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def test_stages_keep_whole_rows(spark):
    docs, labels, y = labelled(spark)
    ranking, model = C.fit(docs, labels), R.fit(docs, labels)
    kept = C.keep_rows(docs, lambda _, x: ranking.score(x) >= C.THRESHOLD)
    assert kept.schema == docs.schema
    good = {i for i, q, _ in y[:300] if q}
    assert len(good - {r.doc_id for r in kept.collect()}) <= 5
    assert model.roots.size


def test_all_pairs_are_ranked_as_brute_force_does():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.3, 1, (700, 4)), rng.normal(-0.3, 1, (90, 4))
    w = rng.normal(0, 1, 4)
    diff = (good[:, None, :] - bad[None, :, :]).reshape(-1, 4)
    p = 1 / (1 + np.exp(diff @ w))
    grad, hess = C.pair_sums(good, bad, w)
    assert np.allclose(grad, diff.T @ p / len(diff)) and np.allclose(hess, (diff * (p * (1 - p))[:, None]).T @ diff / len(diff))


def test_the_ranking_is_where_the_loss_of_all_pairs_is_least():
    rng = np.random.default_rng(3)
    y = np.r_[np.ones(150), np.zeros(50)]
    x = rng.random((200, 15)) + 0.2 * y[:, None] * (np.arange(15) < 3)
    m = C.fit_ranking(x, y)
    z = (C.expand(x) - m.mean) / m.scale
    diff = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, z.shape[1])
    assert np.allclose(diff.T @ (1 / (1 + np.exp(diff @ m.weights))) / len(diff), C.L2 * m.weights, atol=1e-4)


def test_stage_rows_with_odd_columns(spark):
    docs = spark.createDataFrame([(None, None, 1, "a"), (None, None, 1, "a"), (1, "word " * 90, None, None), (2, "", 2, "b")], "doc_id long, text string, features int, id string")
    kept = C.keep_rows(docs, lambda base, x: np.array([b[0] != 90 for b in base]))
    assert kept.schema == docs.schema and sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id <> 1").collect()))
    assert C.keep_rows(docs.limit(0), lambda base, x: np.ones(len(base))).collect() == []
