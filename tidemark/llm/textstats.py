"""Statistics of a whole text, of which quality rules and the quality classifier make their features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, texts

SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbols", "bangs", "pipes", "upper", "digits", "stops", "dup_lines", "repeat_words",
    "distinct_words", "top_word", "same_as_before", "longest_word", "beyond_ascii",
]


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """BASE and FEATURES of a UTF-8 text; all zero without words. Words are runs without space or U+0009 to U+000D."""
    words = text.split()
    n = len(words)
    if not n:
        hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        return [0, 0, int(hist[list(SYMBOLS)].sum()), 0, 0], [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    continued = int(hist[0x80:0xC0].sum())
    white = int(hist[9:14].sum() + hist[32])
    chars = len(text) - continued - white
    symbols = int(hist[list(SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))

    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    repeated = 0
    if n >= 3:
        pairs = ids[:-2] * len(numbers) + ids[1:-1]
        if len(numbers) > 2_000_000:  # else three numbers fit in 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, inverse, counts = np.unique(pairs * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
        if len(counts) < n - 2:
            cover = np.zeros(n, bool)
            again = counts[inverse] > 1
            for j in range(3):
                cover[j : n - 2 + j] |= again
            repeated = int(cover.sum())
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    features = [
        float(np.log1p(n)), chars / n, symbols / n, int(hist[33]) / n, int(hist[124]) / n, upper / max(1, upper + lower),
        int(hist[48:58].sum()) / chars, int(hist[44] + hist[46]) / n, dup_lines / max(1, len(lines)), repeated / n,
        len(numbers) / n, int(np.bincount(ids).max()) / n, float(np.mean(ids[1:] == ids[:-1])) if n > 1 else 0.0,
        float(np.log1p(max(map(len, words)))), continued / chars,
    ]
    return [n, chars, symbols, dup_lines, repeated], features


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, BASE columns, features array) for every row of df; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in texts(b)]
            base = [pa.array([x[0][j] for x in found], pa.int64()) for j in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([b.column(0), *base, pa.array([x[1] for x in found], pa.list_(pa.float64()))], names=["id", *BASE, "features"])

    small_batches(df.sparkSession)
    schema = "id long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>"
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_rows(docs: DataFrame, keep: Callable[[list[list[int]], np.ndarray], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows, whole and in their columns, for which keep says so, given the BASE statistics and the features of a batch's texts. One pass: texts are not shuffled.

    Any columns pass through, whatever their names and nulls; a null text has the statistics of an empty one. Repeated rows
    are judged alike, an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in texts(b, text_col)]
            if found:
                yield b.filter(pa.array(keep([x[0] for x in found], np.array([x[1] for x in found])).astype(bool)))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, where: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of at most max_rows labelled documents: those whose id has the least hashes.

    The sample is bounded before it meets the texts, so what is broadcast and what reaches the driver is bounded by
    max_rows. A document with both labels counts as 0; labels other than 0 and 1, and null ids, are ignored.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if where is not None:
        y = y.where(where)
    y = y.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    rows = with_statistics(some).groupBy("id").agg(F.min("features").alias("features"))
    rows = rows.join(F.broadcast(y), "id").orderBy("id").select("features", "y").collect()
    if not rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.array([r.features for r in rows]), np.array([r.y for r in rows], float)
