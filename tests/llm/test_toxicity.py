import random

import numpy as np
import pytest

from tidemark.llm import toxicity as T

SCHEMA = "doc_id long, text string, toxic int, id string, p_toxic string"


def corpus(spark, n=600, seed=0):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("al", "be", "co", "du", "en") for b in ("ta", "re", "mo", "li", "na", "su")]
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if bad:
            for _ in range(rng.randrange(2, 5)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "stupid", "moron"]) if i % 12 else "krotz" + rng.choice(["en", "ig", "um"])
        rows.append((i, " ".join(w).capitalize(), 5, "x", "y"))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (2, 1, None), (3, 1, 9), (10**7, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels, _ = corpus(spark)
    return T.fit(docs, labels)


def test_held_out_documents(spark, model):
    docs, _, labels = corpus(spark, seed=1)
    truth = {i: t for i, _, t in labels[:600]}
    out = T.toxicity(docs, model).collect()
    assert np.mean([r.toxic == truth[r.id] for r in out]) > 0.98
    assert all(0 <= r[c] <= 1 for r in out for c in (*(f"p_category_{j}" for j in (1, 2, 3, 4)), "p_toxic"))


def test_unseen_ending_of_a_known_stem(spark, model):
    docs = spark.createDataFrame([(1, "alta krotzal beta krotzor " * 2, 0, "", ""), (2, "alta bere " * 9, 0, "", "")], SCHEMA)
    assert {r.id: r.toxic for r in T.toxicity(docs, model).collect()} == {1: 1, 2: 0}


def test_odd_rows(spark, model):
    rows = [(None, "idiot stupid moron idiot", 0, "", ""), (1, None, 0, "", ""), (2, "", 0, "", ""), (2, "", 0, "", ""), (3, "alta " * 60_000, 0, "", "")]
    out = T.toxicity(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert [r.toxic for r in out if r.id is None] == [1]
    assert [r.toxic for r in out if r.id is not None] == [0, 0, 0, 0]
    assert T.toxicity(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_no_labels_or_one_class(spark):
    docs, labels, _ = corpus(spark, 30)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        chain = T.fit(docs, some)
        assert all(r.toxic in (0, 1) for r in T.toxicity(docs, chain).collect())


def dense(x):
    return T.Sparse([(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x], x.shape[1])


def test_later_links_train_on_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = dense(rng.integers(0, 2, (200, 5)).astype(float))
    noise = rng.integers(0, 2, 200).astype(float)  # cannot be learned, only remembered
    seen = []
    real = T.fit_linear

    def spy(z, said, y, l2=T.L2):
        seen.append(said)
        return real(z, said, y, l2)

    T.fit_linear, chain = spy, None
    try:
        chain = T.fit_chain(x, [noise, noise], {}, ["a", "b"])
    finally:
        T.fit_linear = real
    said = seen[1 + T.FOLDS]  # what the second link is fitted on
    assert said.shape == (200, 1)
    fold = np.arange(200) % T.FOLDS
    none = np.zeros((200, 0))
    for k in range(T.FOLDS):
        held = fold == k
        assert np.allclose(said[held, 0], real(x.take(~held), none[~held], noise[~held]).probability(x.take(held), none[held]))
    assert len(chain.links) == 2


def test_fit_is_the_minimum():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (300, 6)).astype(float)
    said = rng.random((300, 2))
    y = (x[:, 0] + said[:, 1] + rng.normal(0, 1, 300) > 1.5).astype(float)
    m = T.fit_linear(dense(x), said, y, 0.5)
    r = m.probability(dense(x), said) - y
    assert np.allclose(x.T @ r + 0.5 * m.weights, 0, atol=0.02) and np.allclose(said.T @ r + 0.5 * m.said, 0, atol=0.02) and abs(r.sum()) < 0.02


def test_counts_and_probabilities_equal_brute_force(spark):
    import math
    import re

    docs, labels, truth = corpus(spark, 300, seed=3)
    s = T.sample_of(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect()}
    y = {i: t for i, _, t in truth if i in rows and t in (0, 1)}
    ids = sorted(y)
    assert s.y.tolist() == [y[i] for i in ids]
    tokens = lambda w: [w, *(w[:n] + "-" for n in T.STEMS if len(w) > n)]
    words = {i: re.findall("[a-z]+", rows[i].lower()) for i in ids}
    has = {i: {t for w in words[i] for t in tokens(w)} for i in ids}
    n1 = sum(y.values())
    n0, want = len(ids) - n1, set()
    for t in set().union(*has.values()):
        a, b = sum(t in has[i] for i in ids if y[i]), sum(t in has[i] for i in ids if not y[i])
        n, total = a + b, n0 + n1
        if T.MIN_DOCUMENTS <= n < total and total * (a * n0 - b * n1) ** 2 / (n * (total - n) * n0 * n1) >= T.CHI_SQUARED:
            want.add(t)
    assert set(s.features) == want
    names, chain = sorted(want), T.fit_sample(s)
    for out in T.toxicity(docs, chain).collect()[:40]:
        p, x = [], [math.log1p(sum(tokens(w).count(t) for w in words[out.id])) for t in names] if out.id in words else None
        if x is None:
            continue
        for link in chain.links:
            z = sum(a * b for a, b in zip(x, link.weights, strict=True)) + sum(a * b for a, b in zip(p, link.said, strict=True)) + link.bias
            p.append(1 / (1 + math.exp(-z)))
        assert [out[f"p_{c}"] for c in chain.names] == pytest.approx(p)
        assert out.toxic == (p[-1] >= chain.threshold)


def test_categories_are_learned_in_every_language(spark):
    """Two languages that share no word, each with its own toxic words: each has a category, which says more there than elsewhere; the chain loses nothing to one model."""
    rng = random.Random(5)
    langs = [([f"{a}{b}{c}" for a in "bdg" for b in "ae" for c in ("lin", "sto")], ["kruzt", "kruzo", "krumpf"]), ([f"{a}{b}{c}" for a in "fmp" for b in "ou" for c in ("ren", "vi")], ["zwilla", "zwicko", "zwenz"])]
    docs, labels = [], []
    for i in range(500):
        words, bad = langs[i % 2]
        w = [rng.choice(words) for _ in range(60)]
        if i % 10 < 2:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(bad)
        docs.append((i, " ".join(w), 0, "", ""))
        labels.append((i, 1, int(i % 10 < 2)))
    d = spark.createDataFrame(docs, SCHEMA)
    s = T.sample_of(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    of = T.clusters(s.x, s.y, 2)
    assert {(i % 2, of[i]) for i in range(500) if of[i] >= 0} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})
    chain, alone = T.held_out_errors(s, 2), T.held_out_errors(s, 0)
    assert chain["missed"] + chain["wrong"] <= alone["missed"] + alone["wrong"] + 2
    out = T.toxicity(d, T.fit_sample(s, 2)).collect()
    for j in (0, 1):
        mine = [r for r in out if r.id % 2 == j and r.id % 10 < 2]
        assert abs(np.mean([r.p_category_1 for r in mine]) - np.mean([r.p_category_2 for r in mine])) > 0.5


def test_threshold_separates():
    p, y = np.array([0.1, 0.2, 0.7, 0.9]), np.array([0.0, 0, 1, 1])
    assert T.best_threshold(p, y) == pytest.approx(0.45)
    assert T.best_threshold(p, np.zeros(4)) == 0.5
