"""Substring dedup by fixed-block anchors: every stretch of 35 words that occurs twice anywhere in a corpus is found and cut out.

The blocks of 18 words that lie side by side in a text are the reference index. A window of 35 words holds one of them whole, so a repeated window
holds a block that turns up elsewhere, at any place. Every rolling window of a block's length is a probe: blocks whose words are probed from two places or
more are hits. A hit is extended to both sides: each window around it that occurs elsewhere, to the word, belongs to a repeat, and
windows side by side make up the maximal repeats. Extension compares 128-bit hashes of whole windows in groups instead of texts in
pairs, so a passage that a third of all texts share costs what its own words cost.

Packed arrays go through the shuffles, a row for each bucket of hashes and two million hashes of a task: a probe is 4 bytes, which only select
candidates; a block or window that a task cannot settle alone goes with the MD5 of its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidemark.llm.common import materialise, small_batches, table, texts

WINDOW = 35
#: Hashes that a task gathers before it sorts and sends them, and that a task of the other side gets on average.
GATHERED, RECEIVED = 2_000_000, 4_000_000
MULTIPLIER = 0x9E3779B97F4A7C15
KEY = ("key", "<u8", 2)
BLOCK = np.dtype([("hash", "<u4"), KEY, ("at", "<i4")])
HASH = np.dtype([("h", "<u8"), ("g", "<u8")])
PLACE = np.dtype([("h", "<u8"), ("g", "<u8"), KEY, ("at", "<i4")])
SPAN = np.dtype([KEY, ("first", "<i4"), ("last", "<i4")])


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2^64, as many as the longest text so far needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            for name, base in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 1 << 64))):
                steps = np.full(1 << n.bit_length(), base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word, (words, 2)."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """For each start a 64-bit hash of the next `length` words: the sum of word hash times multiplier^place, modulo 2^64."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = _Powers.get(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:n])))
    return (sums[length:] - sums[:-length]) * down[: n - length + 1]


def _dealt(columns: dict[str, tuple[np.ndarray, np.ndarray]], bits: int, sure: np.ndarray, turn: int) -> pa.RecordBatch:
    """A row for each bucket with values: columns are (bucket of each value, in order; values). Spans that are sure ride with one bucket, in turn."""
    edges = {name: np.searchsorted(bucket, np.arange((1 << bits) + 1)) for name, (bucket, _) in columns.items()}
    lucky = (TaskContext.get().partitionId() * 31 + turn) % (1 << bits)
    filled = sum(e[1:] - e[:-1] for e in edges.values())
    filled[lucky] += len(sure)
    at = np.flatnonzero(filled)
    data = {name: pa.array([columns[name][1][e[b] : e[b + 1]].tobytes() for b in at], pa.binary()) for name, e in edges.items()}
    return pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), **data, "sure": pa.array([sure.tobytes() if b == lucky else b"" for b in at], pa.binary())})


def _gathered(batches: Iterator[pa.RecordBatch], name: str, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column and the bucket of each."""
    parts, buckets = [np.empty(0, kind)], [np.empty(0, np.uint64)]
    for b in batches:
        for at, raw in zip(b.column("bucket").to_pylist(), b.column(name).to_pylist()):
            parts.append(np.frombuffer(raw, kind))
            buckets.append(np.full(len(parts[-1]), at, np.uint64))
    return np.concatenate(parts), np.concatenate(buckets)


def _spans(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), SPAN)
    out["key"], out["first"], out["last"] = key, first, last
    return out


def _by_text(spans: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, spans): the (first, last) pairs of a text, packed; neighbours are joined."""
    spans = spans[np.lexsort((spans["first"], spans["key"][:, 1], spans["key"][:, 0]))]
    if not len(spans):
        return
    fresh = np.concatenate(([True], (spans["key"][1:] != spans["key"][:-1]).any(axis=1)))
    apart = np.flatnonzero(fresh | np.concatenate(([True], spans["first"][1:] > spans["last"][:-1] + 1)))
    pairs = np.stack([spans["first"][apart], np.maximum.reduceat(spans["last"], apart)], 1).astype("<i4")
    starts = np.flatnonzero(fresh[apart])
    ends = np.append(starts[1:], len(apart))
    keys = spans["key"][apart[starts]].astype("<u8")
    for k in range(0, len(starts), 10_000):
        rows = range(k, min(k + 10_000, len(starts)))
        yield pa.RecordBatch.from_pydict({"key": pa.array([keys[r].tobytes() for r in rows], pa.binary()), "spans": pa.array([pairs[starts[r] : ends[r]].tobytes() for r in rows], pa.binary())})


def _unpacked(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed or b"", "<i4").reshape(-1, 2)


def owner_bits(parts: int) -> int:
    """Buckets of texts: two to four for each task, so that rows stay few and large."""
    return (2 * parts).bit_length()


def _exchange(rows: DataFrame, bits: int, parts: int, meet: Callable[[Iterator[pa.RecordBatch]], np.ndarray], name: str) -> DataFrame:
    """Packed rows meet by bucket of the hashes; the spans that come out go on, packed again, to buckets of texts. Stored as (key, packed spans), a row for each text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = meet(batches)
        spans = spans[np.argsort(spans["key"][:, 0])]
        edges = np.searchsorted(spans["key"][:, 0] >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
        at = np.flatnonzero(edges[1:] > edges[:-1])
        yield pa.RecordBatch.from_pydict({"owner": pa.array(at, pa.int32()), "spans": pa.array([spans[edges[b] : edges[b + 1]].tobytes() for b in at], pa.binary())})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(raw, SPAN) for b in batches for raw in b.column("spans").to_pylist()]
        yield from _by_text(np.concatenate([np.empty(0, SPAN), *parts]))

    out = rows.repartition(parts, "bucket").mapInArrow(found, "owner int, spans binary")
    return materialise(rows.sparkSession, out.repartition(parts, "owner").mapInArrow(joined, "key binary, spans binary"), name)


def hits(keyed: DataFrame, block: int, bits: int, parts: int, gathered: int = GATHERED) -> DataFrame:
    """(key, spans) of the blocks, by number, whose words are probed from two places or more. keyed: key, text. Four bytes of a hash and its bucket decide, so a few more may come out."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, blocks, owners, numbers, keys, held, turn = [], [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            seen, counts = np.unique(np.concatenate(probes), return_counts=True)
            value, key, at = np.concatenate(blocks), np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[np.concatenate(owners)], np.concatenate(numbers)
            settled = counts[np.searchsorted(seen, value)] > 1
            sure = _spans(key[settled], at[settled], at[settled])
            value, key, at = value[~settled], key[~settled], at[~settled]
            order = np.argsort(value)
            top, low = (lambda v: v >> np.uint64(64 - bits)), (lambda v: (v >> np.uint64(32 - bits)).astype("<u4"))
            asked = np.empty(len(order), BLOCK)
            asked["hash"], asked["key"], asked["at"] = low(value[order]), key[order], at[order]
            once, twice = seen[counts == 1], seen[counts > 1]
            return _dealt({"once": (top(once), low(once)), "twice": (top(twice), low(twice)), "asked": (top(value[order]), asked)}, bits, sure, turn)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), texts(b)):
                words = text.split()
                if len(words) < block:
                    continue
                found = rolling(word_hashes(words)[:, 0], block)
                probes.append(found)
                blocks.append(found[::block])
                owners.append(np.full(len(blocks[-1]), len(keys)))
                numbers.append(np.arange(len(blocks[-1]), dtype=np.int32))
                keys.append(key)
                held += len(found)
                if held >= gathered:
                    yield flush()
                    probes, blocks, owners, numbers, keys, held, turn = [], [], [], [], [], 0, turn + 1
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        batches = list(batches)
        wide = lambda name: (lambda v, at: np.sort(v + (at << np.uint64(32))))(*_gathered(batches, name, np.dtype("<u4")))
        once, twice = wide("once"), wide("twice")
        asked, at = _gathered(batches, "asked", BLOCK)
        value = asked["hash"] + (at << np.uint64(32))
        times = sum(w * (np.searchsorted(x, value, "right") - np.searchsorted(x, value)) for w, x in ((1, once), (2, twice)))
        asked = asked[times > 1]
        sure, _ = _gathered(batches, "sure", SPAN)
        return np.concatenate((sure, _spans(asked["key"], asked["at"], asked["at"])))

    rows = keyed.mapInArrow(send, "bucket int, once binary, twice binary, asked binary, sure binary")
    return _exchange(rows, owner_bits(parts), parts, meet, "hits")


def repeats(keyed: DataFrame, found: DataFrame, window: int, block: int, bits: int, parts: int, gathered: int = GATHERED) -> DataFrame:
    """(key, spans) of the starts of windows that occur elsewhere too. Texts with hits are taken once each, with the number of their copies."""
    distinct = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    rows = distinct.join(found, "key").select("key", "text", "copies", "spans")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, starts, copied, keys, whole, held, turn = [], [], [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            both, owner, at, flag = np.concatenate(hashes), np.concatenate(owners), np.concatenate(starts), np.concatenate(copied)
            key = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            order = np.lexsort((both[:, 1], both[:, 0]))
            both, owner, at, flag = both[order], owner[order], at[order], flag[order]
            first = np.flatnonzero(np.concatenate(([True], (both[1:] != both[:-1]).any(axis=1))))
            size = np.diff(np.append(first, len(both)))
            again = (size > 1) | np.logical_or.reduceat(flag, first)
            known = np.repeat(again, size)
            twice = np.empty(int(again.sum()), HASH)
            twice["h"], twice["g"] = both[first[again], 0], both[first[again], 1]
            asked = np.empty(int((~known).sum()), PLACE)
            asked["h"], asked["g"], asked["key"], asked["at"] = both[~known, 0], both[~known, 1], key[owner[~known]], at[~known]
            mine = known & ~flag
            ends = np.array(whole, np.int64).reshape(-1, 2)
            sure = np.concatenate((_spans(key[owner[mine]], at[mine], at[mine]), _spans(key[ends[:, 0]], np.zeros(len(ends), np.int32), ends[:, 1])))
            top = lambda v: v >> np.uint64(64 - bits)
            return _dealt({"twice": (top(twice["h"]), twice), "asked": (top(asked["h"]), asked)}, bits, sure, turn)

        for b in batches:
            for key, text, copies, packed in zip(b.column(0).to_pylist(), texts(b), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = text.split()
                last = len(words) - window
                if last < 0:
                    continue
                inside = np.zeros(last + 1, bool)
                for x, y in _unpacked(packed).tolist():
                    inside[max(0, block * x - block + 1) : block * y + 1] = True
                at = np.flatnonzero(inside).astype(np.int32)
                if not len(at):
                    continue
                h = word_hashes(words)
                hashes.append(np.stack([rolling(h[:, 0], window)[at], rolling(h[:, 1], window)[at]], 1))
                owners.append(np.full(len(at), len(keys)))
                starts.append(at)
                copied.append(np.full(len(at), copies > 1))
                if copies > 1:
                    whole.append((len(keys), last))
                keys.append(key)
                held += len(at)
                if held >= gathered // 2:
                    yield flush()
                    hashes, owners, starts, copied, keys, whole, held, turn = [], [], [], [], [], [], 0, turn + 1
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        batches = list(batches)
        asked, (twice, _) = _gathered(batches, "asked", PLACE)[0], _gathered(batches, "twice", HASH)
        h, g = np.concatenate((asked["h"], twice["h"])), np.concatenate((asked["g"], twice["g"]))
        sure, _ = _gathered(batches, "sure", SPAN)
        if len(h):
            order = np.lexsort((g, h))
            first = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1]))))
            size = np.diff(np.append(first, len(h)))
            weight = np.add.reduceat(np.where(order < len(asked), 1, 2), first)
            known = order[np.repeat(weight > 1, size)]
            known = known[known < len(asked)]
            sure = np.concatenate((sure, _spans(asked["key"][known], asked["at"][known], asked["at"][known])))
        return sure

    out = rows.mapInArrow(send, "bucket int, twice binary, asked binary, sure binary")
    return _exchange(out, owner_bits(parts), parts, meet, "repeats")


ADDED = ("n_words", "n_removed", "spans", "kept")


def substring_dedup(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gathered: int = GATHERED) -> DataFrame:
    """docs with n_words, n_removed, spans (array of start, length: the maximal stretches to remove, in words) and kept (the words that
    stay, joined by single spaces).

    A word goes if a window of `window` words over it has the same words as one that starts elsewhere, in this text or another, on the input as
    it is: no first copy is spared. Null texts and texts shorter than a window lose nothing; repeated rows lose all they have, if that is a
    window or more; null ids have no effect. Other columns stay, and columns of the four names are replaced. Words are runs without space and U+0009 to U+000D.
    """
    if text_col in ADDED or window < 2:
        raise ValueError("the text column must not have the name of a result, and a window has two words or more")
    spark, block = docs.sparkSession, (window + 1) // 2
    rest = [c for c in docs.columns if c not in (*ADDED, text_col)]
    rows = docs.select(F.struct(*(rest or [F.lit(0)])).alias("row"), F.unhex(F.md5(F.col(text_col))).alias("key"), F.col(text_col).alias("text"))
    keyed = rows.where("text is not null").select("key", "text")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // (6 * RECEIVED)))
    bits = min(24, max(10, (4 * parts).bit_length()))
    small_batches(spark)
    found = repeats(keyed, hits(keyed, block, bits, parts, gathered), window, block, bits, parts, gathered)
    spans = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType())]), False)
    schema = StructType([rows.schema["row"], rows.schema["text"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("spans", spans), StructField("kept", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, removed, offsets, stretches, kept = [], [], [0], [], []
            for text, packed in zip(texts(b), b.column(2).to_pylist()):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                for x, y in _unpacked(packed).tolist():
                    edge[x] += 1
                    edge[y + window] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                ends = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8))).reshape(-1, 2)
                stretches += [(int(x), int(y - x)) for x, y in ends]
                offsets.append(len(stretches))
                n_words.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone)] if removed[-1] else words).decode())
            flat = np.array(stretches, np.int64).reshape(-1, 2)
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], names=["start", "length"])
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            columns = [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), found, pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", *ADDED])

    out = rows.join(found, "key", "left").select("row", "text", "spans").mapInArrow(cut, schema)
    own = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED]
    return out.select(*own, *ADDED)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows counted as they are, without hashes.
OP13_SQL = """
with texts as (select row_number() over () as nth, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
starts as (select nth, words, unnest(range(0, greatest(0, len(words) - 34))) as s from texts),
windows as (select nth, s, md5(array_to_string(list_slice(words, s + 1, s + 35), ' ')) as w from starts),
again as (select w from windows group by w having count(*) > 1),
gone as (select distinct nth, s + unnest(range(35)) as word from windows where w in (select w from again)),
lists as (select nth, list(word) as gone from gone group by nth),
cut as (
    select doc_id, len(words) as n_words, coalesce(len(gone), 0) as n_removed,
        case when gone is null then words else list_transform(list_filter(range(len(words)), lambda i: not list_contains(gone, i)), lambda i: words[i + 1]) end as kept
    from texts left join lists using (nth))
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from cut
"""
