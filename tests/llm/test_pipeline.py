import collections
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import mixing, packing
from tidemark.llm import quality_classifier as C
from tidemark.llm import quality_rules as R
from tidemark.llm.textstats import statistics

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(tmp_path, spark):
    """Clean documents, junk, exact and near copies, in three sources; labels on two thirds."""
    rng = random.Random(0)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("ren", "sto", "li", "ga")]
    docs, kinds = [], {}

    def add(text, kind):
        i = len(docs)
        docs.append((i, text, "en", f"s{i % 3}", len(text or "")))
        kinds[i] = kind

    for _ in range(150):
        w = [rng.choice(words) for _ in range(rng.randrange(80, 200))]
        add(" ".join(w), "clean")
    for _ in range(60):
        w = [rng.choice(words) + rng.choice(["***", "###", "%%%"]) for _ in range(rng.randrange(80, 200))]
        add(" ".join(w), "junk")
    for i in range(0, 30, 3):
        add(docs[i][1], ("copy", i))
        w = docs[i + 1][1].split()
        w[len(w) // 2] = "changed"
        add(" ".join(w), ("copy", i + 1))
    for t in (None, "", "short text"):
        add(t, "junk")
    labels = [(i, int(kinds[i] != "junk"), 0) for i in kinds if i % 3]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs, kinds


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    docs, kinds = make(folder, spark)
    out, df = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(folder))
        df.write.parquet(f"{folder}/out-{k}")
        df = spark.read.parquet(f"{folder}/out-{k}")
        out.append(df)
    return str(folder), docs, kinds, out


def test_stages_return_the_columns_of_documents(stages):
    _, _, _, out = stages
    for df in out[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stages_equal_brute_force(spark, stages):
    folder, docs, kinds, out = stages
    d, y = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    ranking, trees = C.fit(d, y), R.fit(d, y)
    stats = {i: statistics((t or "").encode()) for i, t, *_ in docs}
    first = {i for i in stats if ranking.score(np.array([stats[i][1]]))[0] >= C.THRESHOLD}
    assert {r.doc_id for r in out[0].collect()} == first
    second = {i for i in first if stats[i][0][0] >= 50 and 2 * stats[i][0][4] <= stats[i][0][0] and trees.probability(np.array([stats[i][1]]))[0] >= R.KEEP_AT}
    assert {r.doc_id for r in out[1].collect()} == second
    assert {i for i, k in kinds.items() if k == "clean"} <= second
    assert not {i for i, k in kinds.items() if k == "junk"} & second


def test_one_of_each_group_stays(stages):
    _, _, kinds, out = stages
    kept = [r.doc_id for r in out[2].collect()]
    assert len(kept) == len(set(kept))
    assert set(kept) == {i for i, k in kinds.items() if k == "clean"}


def test_mix_and_sequences(spark, stages):
    _, _, _, out = stages
    taken = {r.id: (r.taken // r["size"] if r["size"] else 0) for r in mixing.mix(out[2]).collect()}
    copies = collections.Counter(r.doc_id for r in out[3].collect())
    assert dict(copies) == {i: n for i, n in taken.items() if n}
    slow = Tokenizer.from_file(packing.vocabulary_path())
    texts = {r.doc_id: r.text for r in out[2].collect()}
    want = sum(n * (len(slow.encode(texts[i], add_special_tokens=False).ids) + 1) for i, n in copies.items())
    rows = out[4].collect()
    assert sum(r.length for r in rows) == want
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))


def test_run_equals_the_stages(spark, stages):
    folder, _, _, out = stages
    key = lambda df: sorted((r.doc_id, r.start, bytes(r.ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(out[4])


def test_nulls_and_an_empty_table(spark, stages, tmp_path):
    folder, *_ = stages
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(None, long, None, None, None), (1, None, None, None, None), (2, long, None, "s", 1), (2, long, None, "s", 1)]
    for some in (rows, []):
        df = spark.createDataFrame(some, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            before, df = df.columns, stage(spark, df, folder)
            df.collect()
            assert df.columns == before or "sequence_id" in df.columns
