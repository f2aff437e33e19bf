"""Toxicity by a classifier chain: categories are predicted one after another, and each linear model also sees the
probabilities of the categories before it. Those are out-of-fold probabilities while it is trained.

The labels name one category only, toxic. The others are learned from them: toxic labelled documents are clustered by
the words that set them apart, in whatever languages there are, and each cluster is a category before the last."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, small_batches, table, texts

LAST = "toxic"
#: Labelled documents that the chain is trained on, at most; folds; clusters of toxic documents.
MAX_ROWS, FOLDS, CLUSTERS = 12_000, 4, 4
#: A token is a feature if it is in so many of these documents and independence of the label is refuted at 1 % (chi-squared, one degree of freedom). Their number has no cap.
MIN_DOCUMENTS, CHI_SQUARED = 5, 6.635
#: Lengths of the stems that a word shares with its inflections and compounds.
STEMS = (4, 5, 6)
L2 = 0.3
#: Words whose features a task remembers.
REMEMBERED = 1 << 18
WORD = re.compile(r"[^\W\d_]+")


def tokens_of(word: str) -> list[str]:
    """A word's features: itself, and its stems."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def words_of(text: bytes) -> Counter[str]:
    return Counter(WORD.findall(text.decode().lower()))


class Sparse:
    """A matrix of rows of (column, value) pairs."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.shape = (len(rows), width)
        self.row = np.repeat(np.arange(len(rows)), [len(j) for j, _ in rows]) if rows else np.zeros(0, np.int64)
        self.column = np.concatenate([j for j, _ in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def transposed_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.shape[1])

    def take(self, keep: np.ndarray) -> Sparse:
        out, at = Sparse([], self.shape[1]), keep[self.row]
        number = np.cumsum(keep) - 1
        out.shape, out.row, out.column, out.value = (int(keep.sum()), self.shape[1]), number[self.row[at]], self.column[at], self.value[at]
        return out


@dataclass
class Linear:
    weights: np.ndarray  # of the tokens
    said: np.ndarray  # of the probabilities of earlier categories
    bias: float

    def probability(self, x: Sparse, said: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.dot(self.weights) + said @ self.said + self.bias, -40, 40)))


def fit_linear(x: Sparse, said: np.ndarray, y: np.ndarray, l2: float = L2) -> Linear:
    """Ridge logistic regression by L-BFGS; one class only (or no rows): a constant."""
    n, d, k = len(y), x.shape[1], said.shape[1]
    share = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(d + k + 1)
    w[-1] = np.log(share / (1 - share))
    if not n or y.min() == y.max():
        return Linear(w[:d], w[d : d + k], float(w[-1]))
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(w[:d]) + said @ w[d : d + k] + w[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * w) @ w), np.concatenate([x.transposed_dot(r), r @ said, [r.sum()]]) + ridge * w

    value, grad = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(60):
        q, alphas = grad.copy(), []
        for s, g, rho in reversed(steps):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * g
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(grad).max())
        for (s, g, rho), a in zip(steps, reversed(alphas), strict=True):
            q += (a - rho * (g @ q)) * s
        rate = 1.0
        for _ in range(30):
            new = w - rate * q
            found, more = loss(new)
            if found <= value - 1e-4 * rate * (grad @ q):
                break
            rate /= 2
        s, g = new - w, more - grad
        if s @ g > 1e-12:
            steps = [*steps[-9:], (s, g, 1 / (s @ g))]
        done = value - found < 1e-7 * max(1.0, abs(value))
        w, value, grad = new, found, more
        if done:
            break
    return Linear(w[:d], w[d : d + k], float(w[-1]))


@dataclass
class Chain:
    features: dict[str, int]
    names: list[str]
    links: list[Linear]
    threshold: float

    def probabilities(self, x: Sparse) -> np.ndarray:
        """(rows, categories): each link gets the features and what the links before it said."""
        said = np.zeros((x.shape[0], 0))
        for link in self.links:
            said = np.concatenate([said, link.probability(x, said)[:, None]], 1)
        return said

    def row(self, words: Counter[str], memory: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """The features in a document, in order, each with log(1 + its count in the whole text)."""
        counts: dict[int, int] = {}
        for w, n in words.items():
            at = memory.get(w)
            if at is None:
                at = tuple(self.features[t] for t in tokens_of(w) if t in self.features)
                if len(memory) < REMEMBERED:
                    memory[w] = at
            for j in at:
                counts[j] = counts.get(j, 0) + n
        found = sorted(counts)
        return np.array(found, np.int64), np.log1p(np.array([counts[j] for j in found], float))

    def matrix(self, found: list[Counter[str]], memory: dict[str, tuple[int, ...]]) -> Sparse:
        return Sparse([self.row(words, memory) for words in found], len(self.features))


def clusters(x: Sparse, y: np.ndarray, k: int = CLUSTERS, rounds: int = 20) -> np.ndarray:
    """The cluster, 0 to k - 1 by size, of each toxic row, and -1 for the others: k-means on directions.

    Only tokens that lean to toxic count, by the log of how much likelier they are there. The first centre is the mean of all, the next ones the rows
    least like those before, so no chance is in it.
    """
    bad = y == 1
    out = np.full(len(y), -1)
    if not bad.any() or not x.shape[1]:
        return out
    here = np.bincount(x.column, bad[x.row].astype(float), x.shape[1])
    there = np.bincount(x.column, minlength=x.shape[1]) - here
    lean = np.maximum(0.0, np.log((here + 0.5) / (bad.sum() + 1)) - np.log((there + 0.5) / ((~bad).sum() + 1)))
    some = x.take(bad)
    value = some.value * lean[some.column]
    size = np.sqrt(np.bincount(some.row, value * value, some.shape[0]))
    value = value / np.maximum(size, 1e-12)[some.row]
    n = some.shape[0]

    def mean(of: np.ndarray) -> np.ndarray:
        c = np.bincount(some.column, value * of[some.row], x.shape[1])
        return c / max(1e-12, float(np.sqrt(c @ c)))

    near = lambda c: np.bincount(some.row, value * c[some.column], n)
    closest, centres = near(mean(np.ones(n))), []
    for j in range(min(k, n)):
        row = np.zeros(n)
        row[int(np.argmin(np.where(size > 0, closest, np.inf)))] = 1.0  # a row without such tokens is no centre
        centres.append(mean(row))
        closest = np.maximum(closest, near(centres[-1])) if j else near(centres[-1])
    of = np.zeros(n, np.int64)
    for _ in range(rounds):
        new = np.argmax(np.stack([near(c) for c in centres], 1), 1)
        if (new == of).all():
            break
        of = new
        centres = [mean((of == j).astype(float)) if (of == j).any() else c for j, c in enumerate(centres)]
    order = np.argsort(-np.bincount(of, minlength=len(centres)), kind="stable")
    out[bad] = np.argsort(order)[of]
    return out


def fit_chain(x: Sparse, ys: list[np.ndarray], features: dict[str, int], names: list[str], folds: int = FOLDS) -> Chain:
    """Each link is fitted on all rows for later use, and without each fold for the probabilities that the next links train with.

    The threshold of the last category lies in the middle of the out-of-fold probabilities that separate its labels with the fewest errors.
    """
    n = x.shape[0]
    fold = np.arange(n) % folds
    parts = [(x.take(fold != k), x.take(fold == k)) for k in range(folds)]
    links, said = [], np.zeros((n, 0))
    for y in ys:
        links.append(fit_linear(x, said, y))
        out = np.zeros(n)
        for k, (rest, held) in enumerate(parts):
            out[fold == k] = fit_linear(rest, said[fold != k], y[fold != k]).probability(held, said[fold == k])
        said = np.concatenate([said, out[:, None]], 1)
    return Chain(features, names, links, best_threshold(said[:, -1], ys[-1]) if n else 0.5)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(p, kind="stable")
    s, good = p[order], y[order]
    if not len(s) or good.min() == good.max():
        return 0.5
    errors = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([[(1 - good).sum()], (1 - good).sum() - np.cumsum(1 - good)])
    edges = np.concatenate([[0.0], s, [1.0]])
    best = np.flatnonzero(errors == errors.min())
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[widest] + edges[widest + 1]) / 2)


@dataclass
class Sample:
    """Labelled documents in the order of their ids: features, sparse rows, labels."""

    features: dict[str, int]
    x: Sparse
    y: np.ndarray


def sample_of(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Sample:
    """At most max_rows labelled documents, those whose id has the least hashes; a document with both labels is toxic.

    Tokens are counted in Spark over the sample's whole texts, which are stored in the shared folder; the driver gets the tokens that
    a test tells from chance, and their counts in each document.
    """
    spark = docs.sparkSession
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(LAST).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id")
    small_batches(spark)
    sample = materialise(spark, some, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for t, bad in zip(texts(b), b.column(1).to_pylist(), strict=True):
                seen[bad].update({k for w in words_of(t) for k in tokens_of(w)})
            keys = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)], names=["token", "clean", "bad"])

    counts = sample.select("text", "y").mapInArrow(count, "token string, clean long, bad long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    chosen: list[str] = []
    if n0 and n1:
        n, total = F.col("clean") + F.col("bad"), n0 + n1
        off = F.col("bad") * total - n * n1  # chi-squared of the two-by-two table
        stray = off * off / (n * (total - n).cast("double") * n0 * n1) * total
        chosen = [r.token for r in counts.where((n >= MIN_DOCUMENTS) & (n < total) & (stray >= CHI_SQUARED)).select("token").collect()]
    features = {t: i for i, t in enumerate(sorted(chosen))}
    empty = Chain(features, [], [], 0.5)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[int, ...]] = {}
        for b in batches:
            rows = [empty.row(words_of(t), memory) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([np.asarray(r[j], kind).tobytes() for r in rows], pa.binary()) for j, kind in ((0, "<i4"), (1, "<f4")))], names=["doc_id", "y", "columns", "values"])

    rows = sample.select("doc_id", "y", "text").mapInArrow(measure, "doc_id long, y int, columns binary, values binary")
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.max(F.struct("columns", "values")).alias("x")).orderBy("doc_id").collect()
    x = Sparse([(np.frombuffer(r.x["columns"], "<i4").astype(np.int64), np.frombuffer(r.x["values"], "<f4").astype(float)) for r in rows], len(features))
    return Sample(features, x, np.array([r.y for r in rows], float))


def fit_sample(s: Sample, k: int = CLUSTERS) -> Chain:
    """The chain over the clusters of the sample's toxic rows; without clusters (k = 0) it is one linear model."""
    of = clusters(s.x, s.y, k) if k else np.zeros(0)
    names = [f"category_{j + 1}" for j in range(k)]
    return fit_chain(s.x, [*((of == j).astype(float) for j in range(k)), s.y], s.features, [*names, LAST])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, k: int = CLUSTERS) -> Chain:
    return fit_sample(sample_of(docs, labels, max_rows), k)


def held_out_errors(s: Sample, k: int, parts: int = 5) -> dict[str, float]:
    """Errors, missed toxic and wrongly judged clean documents, and log loss over rows that a chain of k clusters has not been trained on."""
    fold, p, hit = np.arange(len(s.y)) // FOLDS % parts, np.zeros(len(s.y)), np.zeros(len(s.y), bool)
    for j in range(parts):
        held = fold == j
        chain = fit_sample(Sample(s.features, s.x.take(~held), s.y[~held]), k)
        p[held] = chain.probabilities(s.x.take(held))[:, -1]
        hit[held] = p[held] >= chain.threshold
    q = np.clip(p, 1e-9, 1 - 1e-9)
    loss = -float(np.mean(s.y * np.log(q) + (1 - s.y) * np.log(1 - q)))
    return {"rows": len(p), "toxic": int(s.y.sum()), "missed": int((~hit & (s.y == 1)).sum()), "wrong": int((hit & (s.y == 0)).sum()), "log_loss": loss}


def toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category> ..., p_toxic, toxic 0/1) for every row.

    Null and empty texts have no words, so the models' constants judge them. Null ids and repeated rows keep their
    rows; an empty table gives no rows; other columns are ignored. Words of whole texts are counted.
    """
    columns = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[int, ...]] = {}
        for b in batches:
            p = chain.probabilities(chain.matrix([words_of(t) for t in texts(b)], memory))
            hit = (p[:, -1] >= chain.threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(hit)], names=["id", *columns, "toxic"])

    small_batches(docs.sparkSession)
    schema = "id long, " + ", ".join(f"{c} double" for c in columns) + ", toxic int"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's category probabilities and verdict."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
