"""Packing by power-of-two decomposition: documents are cut into pieces of binary length and equal lengths share a bucket."""

from __future__ import annotations

import base64
import importlib.util
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, small_batches, table, texts

MAX_LENGTH, END = 1024, 0
VOCABULARY = "byte_bpe_50k.json"
#: The faster library tries a pattern that looks ahead, and gives up on runs of white space of some hundred thousand characters; it gets none of this length.
LONG_SPACE = re.compile(r"\s{20000}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _encoders(path: str):
    """The tokenizer of a file; and, if its ranks lie beside it, the same vocabulary in a library that is several times faster."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists() or importlib.util.find_spec("tiktoken") is None:
        return slow, None
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.read_bytes().splitlines() if line)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    return slow, tiktoken.Encoding("piece", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)


def encode(path: str, docs: list[str]) -> list[list[int]]:
    """Ids of whole texts, as tokenizers gives them with add_special_tokens=False.

    Texts of code points below U+0250 (ASCII and Latin) go through the faster library. Others, where the two could classify new
    characters differently, texts with very long white space, texts that the faster library refuses, and all texts if there are no ranks, go through tokenizers itself.
    """
    slow, fast = _encoders(path)
    out: list[list[int]] = [[] for _ in docs]
    rest = []
    for i, t in enumerate(docs):
        if fast is not None and (t.isascii() or max(t) < "ɐ") and not (len(t) >= 20_000 and LONG_SPACE.search(t)):
            try:
                out[i] = fast.encode(t, allowed_special="all")
                continue
            except ValueError:  # its regular expressions have a limit on what they keep to go back to
                pass
        rest.append(i)
    for i, e in zip(rest, slow.encode_batch([docs[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
        out[i] = e.ids
    return out


def binary_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """Whole pieces of the maximal length, then the powers of two that make up the rest, longest first."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LENGTH, end: int = END) -> DataFrame:
    """(id, start, length, doc_tokens, ids, part, nth): the pieces of each row's ids with the end id appended; ids as
    little-endian unsigned 32-bit numbers; nth counts a task's (part's) pieces of one length.

    Null and empty texts are the end id alone. Null ids and repeated rows are cut like any other row; other columns are ignored.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "length", "doc_tokens", "ids", "part", "nth"]
        part, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            row, start, length, total, data, nth = [], [], [], [], [], []
            for i, ids in enumerate(encode(path, [t.decode() for t in texts(b)])):
                ids.append(end)
                raw, at = np.array(ids, "<u4").tobytes(), 0
                for n in binary_lengths(len(ids), most):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    total.append(len(ids))
                    data.append(raw[4 * at : 4 * (at + n)])
                    nth.append(seen[n])
                    seen[n] += 1
                    at += n
            longs = (pa.array(x, pa.int64()) for x in (start, length, total))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *longs, pa.array(data, pa.binary()), pa.array([part] * len(row), pa.int64()), pa.array(nth, pa.int64())], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, start long, length long, doc_tokens long, ids binary, part long, nth long")


def number(rows: DataFrame) -> DataFrame:
    """Adds sequence_id: rows numbered from 0, bucket by bucket of equal length (longest first), and offset 0: each piece fills its sequence.

    Nothing is sorted or dealt anew. Each task stores its pieces with their number within task and bucket; a sum for each
    task and bucket (a few rows a task) then shifts them. The stored rows fix the numbers, so lost executors don't change them.
    """
    stored = materialise(rows.sparkSession, rows, "pieces")
    order = Window.orderBy(F.col("length").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored.groupBy("part", "length").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    sums = materialise(rows.sparkSession, sums, "sums")  # of known size: Spark then decides whether the pieces must move to meet them
    out = stored.join(sums, ["part", "length"])
    return out.withColumn("sequence_id", F.col("_before") + F.col("nth")).withColumn("offset", F.lit(0).cast("long")).drop("part", "nth", "_before")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LENGTH) -> DataFrame:
    """Pieces with ids, each numbered as the sequence that it fills alone: no sequence crosses documents and none needs padding. An empty table gives no rows."""
    return number(pieces(docs, path, id_col, text_col, most))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with a digest of their ids. Null texts are the end id alone; texts of any length are whole; repeated rows are packed each; an empty table gives no rows."""
    rows = pieces(table(spark, sf_dir, "documents"), vocabulary_path())
    rows = rows.select(F.col("id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "part", "nth")
    return number(rows).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences with their ids: one row a piece, of which only the id column of docs is left.

    Null texts are the end id alone, null ids and repeated rows are packed like any other; other columns, whatever their names, are dropped; an empty table gives no rows.
    """
    return pack(docs, vocabulary_path()).withColumnRenamed("id", "doc_id")
