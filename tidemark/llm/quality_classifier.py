"""Quality classifier: Bradley-Terry ranking. Documents get scores such that, in pairs of a good and a bad document, the
logistic loss on the difference of their features is least; a quantile of the scores is the threshold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.textstats import FEATURES, keep_rows, labelled_sample, with_statistics

#: Labelled documents that the ranking is learned from, at most. Every pair of a good and a bad one of them counts.
MAX_ROWS = 20_000
#: Good documents whose pairs are in memory at once.
BLOCK = 512
#: Documents of at least this score are predicted good.
THRESHOLD = 0.3
L2 = 1e-3


def expand(x: np.ndarray) -> np.ndarray:
    """Features as they are, and bent so that small shares count."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0)), np.log1p(50 * np.maximum(x, 0)), x * x], 1)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # the quantile of latent scores that maps to THRESHOLD
    slope: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return ((expand(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.latent(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, negative Hessian) of the mean log-likelihood of all pairs, block by block of good rows.

    A pair's probability to be ordered wrongly is p = 1 / (1 + exp(s_good - s_bad)). The sums over pairs of p (g - b) and of p (1 - p) (g - b)(g - b)'
    fall into products of the rows with p's sums by row and by column, so no difference of features is ever made.
    """
    d, n = good.shape[1], len(good) * len(bad)
    grad, hess = np.zeros(d), np.zeros((d, d))
    sb, by_bad, by_bad2 = np.exp(np.clip(bad @ w, -300, 300)), np.zeros(len(bad)), np.zeros(len(bad))
    for at in range(0, len(good), BLOCK):
        g = good[at : at + BLOCK]
        p = sb / (sb + np.exp(np.clip(g @ w, -300, 300))[:, None])
        q = p * (1 - p)
        by_bad += p.sum(0)
        by_bad2 += q.sum(0)
        grad += p.sum(1) @ g
        cross = g.T @ (q @ bad)
        hess += (g * q.sum(1)[:, None]).T @ g - cross - cross.T
    grad -= by_bad @ bad
    hess += (bad * by_bad2[:, None]).T @ bad
    return grad / n, hess / n


def fit_ranking(x: np.ndarray, y: np.ndarray) -> Ranking:
    """Newton's method on the logistic loss of all pairs of one good and one bad document, up to BLOCK good ones by all bad ones at once.

    The cut lies half-way between the scores on either side of the quantile that the share of bad documents gives. Without
    documents of both labels nothing can be ranked: every document scores 0.5.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    e = expand(x)
    if not len(good) or not len(bad):
        d = e.shape[1]
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), -float(np.log((1 - THRESHOLD) / THRESHOLD)), 1.0)
    mean, scale = e.mean(0), e.std(0)
    scale[scale < 1e-9] = 1.0
    z = (e - mean) / scale
    w = np.zeros(z.shape[1])
    for _ in range(12):
        grad, hess = pair_sums(z[good], z[bad], w)
        step = np.linalg.solve(hess + L2 * np.eye(len(w)), grad - L2 * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    s = z @ w
    ordered = np.sort(s)
    k = len(bad)
    cut = float((ordered[k - 1] + ordered[k]) / 2)
    return Ranking(mean, scale, w, cut, float(2 / max(1e-9, s.std())))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves remainder 0 modulo 5; a null id counts as empty text, so as held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Ranking:
    """Learns from at most max_rows labelled documents that are not held out."""
    return fit_ranking(*labelled_sample(docs, labels, "quality", max_rows, ~held_out("id")))


def quality_scores(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; only the text is an input of the score.

    Null and empty texts are scored as texts without words. Null ids and repeated rows keep their rows; an empty table
    gives no rows; other columns of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).flatten()).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["id", "score"])

    return with_statistics(docs, id_col, text_col).select("id", "features").mapInArrow(run, "id long, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and verdict, by a ranking that never saw the held-out labels."""
    docs = table(spark, sf_dir, "documents")
    out = quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score below the threshold; rows that stay are whole, whatever their columns.

    The ranking is learned from the labelled documents of the whole input. A null or empty text is scored as one without words,
    a null id changes nothing, repeated rows share one fate, an empty table stays empty.
    """
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return keep_rows(docs, lambda _, x: model.score(x) >= THRESHOLD)
