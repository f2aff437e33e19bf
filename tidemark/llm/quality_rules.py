"""Quality rules: hard limits on document statistics, then gradient-boosted trees learned from quality labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import trees
from tidemark.llm.common import table
from tidemark.llm.textstats import BASE, FEATURES, keep_rows, labelled_sample, with_statistics

#: The score may not rise (-1) or fall (1) as these features grow.
MONOTONE = {"symbols": -1, "bangs": -1, "pipes": -1, "dup_lines": -1, "repeat_words": -1, "same_as_before": -1, "distinct_words": 1}
#: Labelled rows that the trees are trained on, at most.
MAX_ROWS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents of at least this probability are kept.
KEEP_AT = 0.3


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> trees.Trees:
    """Trees for the label quality, from at most max_rows labelled documents."""
    x, y = labelled_sample(docs, labels, "quality", max_rows)
    return trees.fit(x, y, {FEATURES.index(f): s for f, s in MONOTONE.items()})


def base_fails(n_words, n_repeat_words):
    """The hard limits, of columns or of arrays."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def score(stats: DataFrame, model: trees.Trees) -> DataFrame:
    """Adds probability, by the flattened node arrays over a batch of feature rows at once."""
    names = [c for c in stats.columns if c != "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("features").flatten()).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(model.probability(x))], names=[*names, "probability"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields if f.name != "features")
    return stats.select(*names, "features").mapInArrow(run, f"{fields}, probability double")


def quality_rules(docs: DataFrame, model: trees.Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, probability, base_failed, kept) for every row.

    Null and empty texts have no words, so the base rules fail them. Null ids keep their row; repeated rows are judged
    alike, each in its own row; an empty table gives no rows; other columns of docs are ignored. Without usable labels the trees
    give only the prior, so the base rules alone decide.
    """
    out = score(with_statistics(docs, id_col, text_col), model)
    return out.withColumn("base_failed", base_fails(F.col("n_words"), F.col("n_repeat_words"))).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= KEEP_AT))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base statistics, what the base rules say, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    out = quality_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), *BASE, "base_failed", "kept")


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rules keep, as whole rows with all their columns. The trees are trained on the labelled documents of the whole input.

    Null and empty texts go, since the base rules fail them; null ids change nothing, repeated rows share one fate, an empty table stays empty.
    """
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

    def keep(base: list[list[int]], x: np.ndarray) -> np.ndarray:
        n, repeated = (np.array([b[BASE.index(c)] for b in base]) for c in ("n_words", "n_repeat_words"))
        return ~base_fails(n, repeated) & (model.probability(x) >= KEEP_AT)

    return keep_rows(docs, keep)
