"""A corpus from documents to packed sequences: each stage calls one operator of tidemark.llm on all that the one before has kept.

The models of the first two stages are learned from the labelled rows of the whole table of documents. Rows that the
quality stages reject are gone; of each group of near-duplicates (five-word shingles, similarity about 0.8 or more) the
document of the least id stays; the mix repeats whole documents; the last stage returns sequences with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, quality_classifier, quality_rules, simhash
from tidemark.llm.common import materialise, table

STAGES = [
    ("quality classifier", quality_classifier.stage_quality_classifier),
    ("quality rules", quality_rules.stage_quality_rules),
    ("simhash near-dedup", simhash.stage_near_dedup),
    ("mixing to target weights", mixing.stage_mixing),
    ("packing", packing.stage_packing),
]

#: Learned models, fingerprints and token ids have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is stored in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(spark, docs, name.replace(" ", "-"))
    return docs
