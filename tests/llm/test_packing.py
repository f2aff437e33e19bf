import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing as P

SCHEMA = "doc_id long, text string, id string, length string, start int, _at int"


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(P.vocabulary_path())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 2, 3) for i, t in rows], SCHEMA)


ROWS = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "two words"), (4, "a b " * 3000), (5, "<|endoftext|> é ü ß 你好 🎉"), (6, "  \n\n x\t!!! don't  "), (7, "l" * 300000)]


def test_every_id_lies_in_one_piece(spark, slow):
    rows = ROWS + [(100 + i, "The cat sat. " * i) for i in range(60)]
    out = P.pack(frame(spark, rows), P.vocabulary_path()).collect()
    want = collections.Counter()
    for i, t in rows:
        want[(i, tuple([*slow.encode(t or "", add_special_tokens=False).ids, 0]))] += 1
    by_doc = collections.defaultdict(list)
    for r in out:
        assert len(r.ids) == 4 * r.length and r.offset == 0
        assert r.length <= 1024 and r.length & (r.length - 1) == 0
        by_doc[(r.id, r.doc_tokens)].append(r)
    got = collections.Counter()
    for (i, n), parts in by_doc.items():
        copies = sum(p.start == 0 for p in parts)
        starts = sorted({p.start: p for p in parts}.items())
        ids = b"".join(p.ids for _, p in starts)
        assert len(ids) == 4 * n and len(parts) == copies * len(starts)
        got[(i, tuple(np.frombuffer(ids, "<u4").tolist()))] += copies
    assert got == want
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    by_id = sorted(out, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in out), reverse=True)


def test_empty_table(spark):
    assert P.pack(frame(spark, []), P.vocabulary_path()).collect() == []


def test_numbers_are_gapless_over_many_partitions(spark):
    rows = [(i, "The cat sat. " * (i % 9)) for i in range(50)]
    out = P.pack(frame(spark, rows).repartition(7), P.vocabulary_path()).collect()
    by_id = sorted(out, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in by_id] == list(range(len(out)))
    assert [r.length for r in by_id] == sorted((r.length for r in out), reverse=True)


@given(st.integers(0, 5000))
def test_lengths_are_powers_of_two_that_sum_up(n):
    parts = P.binary_lengths(n)
    assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)
    assert len([p for p in parts if p < 1024]) == len({p for p in parts if p < 1024})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=5))
def test_both_libraries_agree(slow, docs):
    assert P.encode(P.vocabulary_path(), docs) == [slow.encode(t, add_special_tokens=False).ids for t in docs]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F)))
def test_both_libraries_agree_on_latin(slow, text):
    assert P.encode(P.vocabulary_path(), [text]) == [slow.encode(text, add_special_tokens=False).ids]


def test_digest_columns(spark, tmp_path):
    frame(spark, ROWS).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    full = {(r.id, r.start, r.length): zlib.crc32(r.ids) for r in P.pack(frame(spark, ROWS), P.vocabulary_path()).collect()}
    out = P.op5_packing(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.start, r.length): r.ids_crc32 for r in out} == full


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\u00a0"])
def test_long_white_space(slow, space):
    docs = [space * 1_000_000, f"one{space * 1_000_000}two", "a" + space * 19_999 + "b"]
    assert P.encode(P.vocabulary_path(), docs) == [slow.encode(t, add_special_tokens=False).ids for t in docs]


def test_very_long_texts_go_through_spark(spark, slow):
    texts = {1: " " * 5_000_000, 2: "x\n" * 10 + "\n" * 5_000_000 + "y", 3: "word " * 400_000, 4: "ab" * 500_000, 5: "!" * 1_000_000}
    out = P.pack(frame(spark, list(texts.items())).repartition(5), P.vocabulary_path()).select("id", "start", "length", "doc_tokens").collect()
    for i, t in texts.items():
        parts = sorted((r.start, r.length) for r in out if r.id == i)
        assert {r.doc_tokens for r in out if r.id == i} == {len(slow.encode(t, add_special_tokens=False).ids) + 1}
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
