"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set where over half of the hashes of a document's word shingles have it set. Two
fingerprints link at `distance` or fewer differing bits. Candidates come from tables of masked fingerprints: the
positions of a fingerprint get the non-zero vectors of F2^(radius+1) in turn, and the table of each non-zero v keeps
the positions whose vector has an odd product with v. Any `radius` positions span less than the whole space, so some v
is orthogonal to all of them, and its table keeps none of them: every pair within the radius shares that table's key.

The 64-bit default takes the whole fingerprint as the word that is masked, so radius == distance gives every link. Wide
fingerprints (bits > 64) estimate similarity finely, and their tables are laid over several words, each of `word_bits`
positions of the fingerprint: a pair within `radius` in any word becomes a candidate (one a little beyond may), then the distance over
all bits and the shingle sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, components, materialise, small_batches, table, texts

#: Distinct fingerprints of one key that a task compares at once. A key with more is split.
BUCKET = 8192
#: Shingles hashed at once: bounds memory for very long texts.
CHUNK = 1 << 16


def covering_masks(positions: list[int], radius: int, bits: int) -> list[bytes]:
    """The masks over positions of a fingerprint of so many bits (bit 0 is the first of byte 0).

    The unit vectors are dealt first: with more positions than the radius every mask keeps some position, so none is void.
    """
    n = 1 << (radius + 1)
    vectors = sorted(range(1, n), key=lambda v: (v.bit_count() > 1, v))
    vectors = [vectors[i % (n - 1)] for i in range(len(positions))]
    masks = []
    for v in range(1, n):
        keep = np.zeros(bits, np.uint8)
        keep[[p for p, m in zip(positions, vectors, strict=True) if (m & v).bit_count() & 1]] = 1
        masks.append(np.packbits(keep).tobytes())
    return masks


def word_positions(bits: int, words: int, word_bits: int) -> list[list[int]]:
    """Positions of each word: all of a fingerprint that one word covers, else fixed pseudo-random choices."""
    if words == 1 and word_bits >= bits:
        return [list(range(bits))]
    rng = np.random.default_rng(7)
    deal: list[int] = []
    while len(deal) < words * word_bits:  # each position is used about as often as any other
        deal += rng.permutation(bits).tolist()
    return [list(dict.fromkeys(deal[i * word_bits : (i + 1) * word_bits])) for i in range(words)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the k-word shingles of a text, A-Z lower-cased, in chunks; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return
    last = max(1, len(words) - k + 1)
    for at in range(0, last, CHUNK):
        upto = min(last, at + CHUNK)
        if len(words) < k:
            parts = [b" ".join(words)]
        else:
            parts = map(b" ".join, zip(*(words[at + j : upto + j] for j in range(k)), strict=True))
        yield np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(42))), ">u8")


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, in the order of their bytes in memory."""
    n = len(h)
    bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1).view(np.uint64)  # eight counters to a word
    whole = n // 255 * 255
    out = np.zeros(64, np.int64)
    if whole:
        out += bits[:whole].reshape(-1, 255, 8).sum(1, dtype=np.uint64).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    if n > whole:
        out += bits[whole:].sum(0, dtype=np.uint64).view(np.uint8).astype(np.int64)
    return out


def fingerprint(text: bytes, k: int = 3, bits: int = 64, distinct: bool = False) -> bytes:
    """SimHash of a text; all zero without words. Bits beyond the first 64 come from remixed hashes. distinct counts each shingle once, as sets do."""
    total, counts = 0, np.zeros(bits, np.int64)
    found = shingle_hashes(text, k)
    if distinct:
        whole = list(found)
        found = [np.unique(np.concatenate(whole))] if whole else []
    for h in found:
        total += len(h)
        counts[:64] += _bit_counts(h)
        x = h.astype(np.uint64) if bits > 64 else h
        for j in range(1, bits // 64):
            y = _mix(x + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            counts[64 * j : 64 * j + 64] += _bit_counts(y.astype("<u8", copy=False))
    return np.packbits(2 * counts > total).tobytes() if total else bytes(bits // 8)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, bits: int = 64, distinct: bool = False, carry: list[str] = ()) -> DataFrame:
    """(id, fp binary) of every row, and the longs named in carry. A null or empty text has the zero fingerprint; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, k, bits, distinct) for t in texts(b)], pa.binary()), *(b.column(c) for c in carry)], names=["id", "fp", *carry])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carry).mapInArrow(run, "id long, fp binary" + "".join(f", {c} long" for c in carry))


def _fp_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Fixed-width binaries as rows of big-endian 64-bit words."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.reshape(len(column), width).copy().view(">u8").astype(np.uint64).reshape(len(column), width // 8)


def _binary(m: np.ndarray) -> pa.Array:
    width = m.shape[1] * 8 if m.ndim == 2 else 8
    data = np.ascontiguousarray(m.astype(">u8")).tobytes()
    offsets = np.arange(0, len(data) + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _keys(fp: np.ndarray, parent: np.ndarray, mask: np.ndarray, number: int) -> np.ndarray:
    key = _mix(parent + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for j in range(fp.shape[1]):
        key = _mix(key + (fp[:, j] & mask[j]))
    return key


def _masked(nodes: DataFrame, bits: int, words: int, word_bits: int, radius: int) -> DataFrame:
    """The tables: (key, id, fp, free) for each mask; free marks the positions that a key leaves open. key and free of nodes, if there, are the keys to split."""
    width = bits // 8
    deeper = "key" in nodes.columns
    first = [(p, m) for p in word_positions(bits, words, word_bits) for m in covering_masks(p, radius, bits)]
    as_words = lambda m: np.frombuffer(m, ">u8").astype(np.uint64)

    def masks_of(free: bytes) -> list[bytes]:
        return covering_masks(np.flatnonzero(np.unpackbits(np.frombuffer(free, np.uint8))).tolist(), radius, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fp = b.column(0), _fp_matrix(b.column(1), width)
            jobs = [(slice(None), bytes([255]) * width, [m for _, m in first])]
            parent = np.zeros(len(fp), np.uint64)
            if deeper:
                parent = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                frees = np.array(b.column(3).to_pylist(), object)
                jobs = [(np.flatnonzero(frees == f), f, masks_of(f)) for f in sorted(set(frees.tolist()))]
            for rows, free, masks in jobs:
                some, sub, up = ids if isinstance(rows, slice) else ids.take(pa.array(rows)), fp[rows], parent[rows]
                for t, m in enumerate(masks):
                    key = _keys(sub, up, as_words(m), t)
                    rest = (np.frombuffer(free, np.uint8) & ~np.frombuffer(m, np.uint8)).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), some, _binary(sub), pa.array([rest] * len(sub), pa.binary())], names=["key", "id", "fp", "free"])

    out = nodes.select("id", "fp", *(["key", "free"] if deeper else [])).mapInArrow(run, "key long, id long, fp binary, free binary")
    return out if deeper else out.drop("free")


#: Near pairs of a batch that are held before they are joined, least distance first.
HELD_PAIRS = 1 << 20


def _forest(key: np.ndarray, fp: np.ndarray, distance: int, first: tuple[int, int] | None = None, label: np.ndarray | None = None, depth: int = 1, check: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Links (rows i, j) that span the graph of the rows with equal keys within the distance, fewer than rows, and their distances; the least row of each row's component.
    first = (bits, distance) must hold as well for so many first bits.

    Of a batch's near pairs (up to HELD_PAIRS at once) the nearest are joined first, so that a path of near links is not
    given up for a far one. With label only pairs of rows with different labels count, rows of one label being joined
    before, and links come from `depth` forests, one after another, each made of pairs that those before have no use for; the last result says whether pairs are left over. A pair that check refuses is no link.
    """
    n = len(key)
    roots = [np.arange(n) for _ in range(depth)]
    if label is not None:
        for root in roots:
            root[:] = np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]
    rows, lag, more = np.arange(n - 1), 1, False
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    links: list[tuple[int, int, int]] = []

    def find(root: np.ndarray, i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join() -> None:
        nonlocal more
        if not held:
            return
        i, j, far = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((j, i, far))
        i, j, far = i[order], j[order], far[order]
        while len(i):
            some = slice(0, 4096)  # pairs that earlier ones have joined fall out in between
            for a, b, d in zip(i[some].tolist(), j[some].tolist(), far[some].tolist(), strict=True):
                for root in roots:
                    x, y = find(root, a), find(root, b)
                    if x != y and check and not check(a, b):
                        break
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        links.append((a, b, d))
                        break
                else:
                    more = True
            for k, root in enumerate(roots):
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
                roots[k] = root
            i, j, far = i[4096:], j[4096:], far[4096:]
            apart = roots[-1][i] != roots[-1][j]
            more = more or not apart.all()
            i, j, far = i[apart], j[apart], far[apart]

    while True:
        rows = rows[rows + lag < n]
        rows = rows[key[rows] == key[rows + lag]]
        if not len(rows):
            break
        apart = rows[roots[0][rows] != roots[0][rows + lag]] if label is None else rows[label[rows] != label[rows + lag]]
        far = np.zeros(len(apart), np.int64)
        for j in range(fp.shape[1]):
            if first and 64 * j == first[0]:
                apart, far = apart[far <= first[1]], far[far <= first[1]]
            far += np.bitwise_count(fp[apart, j] ^ fp[apart + lag, j])
        near = far <= distance
        if near.any():
            held.append((apart[near], apart[near] + lag, far[near]))
            if sum(len(x[0]) for x in held) > HELD_PAIRS:
                join()
        lag += 1
    join()
    found = np.array(links, np.int64).reshape(-1, 3)
    return found[:, :2], found[:, 2], roots[0], more


def _named(root: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(group, id) for the components of more than one row. A group is named by its ids, so that the same rows have the same name under every key."""
    rows = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
    rows = rows[np.argsort(root[rows], kind="stable")]
    begin = np.flatnonzero(np.diff(root[rows], prepend=-1))
    size = np.diff(begin, append=len(rows))
    total = np.add.reduceat(_mix(ids[rows].view(np.uint64)), begin) if len(rows) else np.zeros(0, np.uint64)
    return np.stack([np.repeat(_mix(total + size.astype(np.uint64)).view(np.int64), size), ids[rows]], 1)


def _bucket_links(rows: DataFrame, bits: int, distance: int, groups: bool = False) -> DataFrame:
    """(a, b, far): links inside each key and their distance, with groups also (group, id) of its components, far null. Keys have been counted: a task gathers one at a time."""

    def links(t: pa.Table) -> pa.RecordBatch:
        ids = t.column("id").to_numpy()
        e, far, root, _ = _forest(t.column("key").to_numpy(), _fp_matrix(t.column("fp").combine_chunks(), bits // 8), distance)
        e, far = np.sort(ids[e], 1), pa.array(far)
        if groups:
            members = _named(root, ids)
            e, far = np.concatenate([e, members]), pa.concat_arrays([far, pa.nulls(len(members), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), far], names=["a", "b", "far"])

    parts = rows.select("key", "id", "fp").repartition(F.col("key")).sortWithinPartitions("key", "id")
    return parts.mapInArrow(lambda batches: _by_key(batches, links), "a long, b long, far long")


def _blocks(rows: DataFrame, bucket: int, level: int) -> DataFrame:
    """(key, id, fp): the rows of each key, which are more than bucket, dealt into three blocks or more; every two blocks are a key of mostly fewer than bucket rows."""
    sizes = rows.groupBy("key").agg(F.ceil(2.25 * F.count("id") / bucket).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64(F.lit(level), "id"), "blocks").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> other")
    return pairs.select(F.xxhash64(F.lit(level), "key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "id", "fp")


def link(nodes: DataFrame, bits: int = 64, distance: int = 3, radius: int = 3, words: int = 1, word_bits: int = 64, bucket: int = BUCKET, groups: bool = False) -> DataFrame:
    """Links (a, b, far) between nodes (id unique and not null, fp) within the distance that share a key; they span each key's graph.
    groups: also rows whose far is null: a is a group and b a node of it, the groups being the components of each key's graph.

    Copies must have been made one node before. Keys are counted first, and one with more than `bucket` fingerprints is not gathered. Where masks cover the distance they are masked anew over the positions that the key's mask left open, which keeps the
    guarantee (the pairs differ only there), until keys are small or no position is open, when all fingerprints would be
    equal. Elsewhere further masks would lose pairs that have met, so the rows are dealt into blocks of which every two meet.
    """
    covering = words == 1 and word_bits >= bits and radius >= distance
    spark = nodes.sparkSession
    bucket = max(bucket, 1 << radius)  # as many fingerprints differ in no more positions than the radius: such keys are never split
    with batches_of(spark, 10_000):  # short rows
        return _link(nodes, bits, distance, radius, words, word_bits, bucket, groups, covering)


def _link(nodes: DataFrame, bits: int, distance: int, radius: int, words: int, word_bits: int, bucket: int, groups: bool, covering: bool) -> DataFrame:
    spark, edges, level, left = nodes.sparkSession, None, 0, nodes
    while True:
        keyed = _blocks(left, bucket, level) if level and not covering else _masked(left, bits, words, word_bits, radius)
        large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key")  # counted within tasks before they are shuffled
        large = materialise(spark, large, f"large-keys-{level}")
        last = large.isEmpty()
        small = keyed if last else keyed.join(large, "key", "left_anti")
        some = materialise(spark, _bucket_links(small, bits, distance, groups), f"links-{level}")
        edges = some if edges is None else edges.unionByName(some)
        if last:
            break
        left = keyed.join(large, "key")  # a key's rows are never gathered: AQE splits what a join by sorting would put in one task
        if level == 0 and covering:  # the first tables do not carry which positions are open: the mask is found again from the key
            left = _with_free(left, bits, words, word_bits, radius)
        left = materialise(spark, left, f"large-rows-{level}")
        level += 1
    return edges


def link_components(nodes: DataFrame, **how) -> DataFrame:
    """Components over link(): (node, component) for nodes that have a link."""
    return components(nodes.sparkSession, link(nodes, **how), "simhash")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, set) of rows (id, text): the distinct hashes of a text's k-word shingles, sorted, as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(np.concatenate(h)).astype("<u8").tobytes() if (h := list(shingle_hashes(t, k))) else b"" for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    small_batches(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(run, "id long, set binary")


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets overlap by the similarity (Jaccard) or more; empty ones never do."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same > 0 and same >= similarity * (len(both) - same) - 1e-9


def confirm(pairs: DataFrame, sets: DataFrame, similarity: float, bits: int = 0, fine: int | None = None) -> DataFrame:
    """The pairs (a, b) whose shingle sets overlap by the similarity (Jaccard) or more, counted exactly; with fine only those within so many of the bits of their
    fingerprints. sets: (id, set), then with fp. A node in many pairs meets them in joins that AQE can split."""
    columns = ["set", "fp"] if fine is not None else ["set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.ones(b.num_rows, bool)
            if fine is not None:
                near = np.bitwise_count(_fp_matrix(b.column(3), bits // 8) ^ _fp_matrix(b.column(5), bits // 8)).sum(axis=1) <= fine
            both = zip(near.tolist(), *(b.column(c).to_pylist() for c in ("set_a", "set_b")), strict=True)
            good = [n and _similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), similarity) for n, x, y in both]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    known = pairs.select("a", "b")
    for c in ("a", "b"):
        known = known.join(sets.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns)), c)
    small_batches(pairs.sparkSession)
    return known.select("a", "b", *(f"{x}_{c}" for c in "ab" for x in columns)).mapInArrow(run, "a long, b long")


def _by_key(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """work() on whole keys of rows that are sorted by a column key, on all those that are complete in a batch at once."""
    kept: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        key = t.column("key").to_numpy()
        if not len(key):
            continue
        if kept and kept[0].column("key")[0].as_py() != key[0]:
            yield work(pa.concat_tables(kept).combine_chunks())
            kept = []
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:  # the last key of the batch may go on in the next
            yield work(pa.concat_tables([*kept, t.slice(0, cut)]).combine_chunks())
            kept = []
        kept.append(t.slice(cut))
    if kept:
        yield work(pa.concat_tables(kept).combine_chunks())


def _exact_links(rows: DataFrame, bits: int, distance: int, coarse: tuple[int, int], similarity: float) -> DataFrame:
    """Links (a, b) of rows (key, id, fp, set, met) with equal keys that span, for each key, the graph of all pairs within the distances that have met in a table and are of the similarity."""

    def links(t: pa.Table) -> pa.RecordBatch:
        key, ids = (t.column(c).to_numpy() for c in ("key", "id"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("set")]
        met = [frozenset(x) for x in t.column("met").to_pylist()]
        check = lambda i, j: not met[i].isdisjoint(met[j]) and _similar(sets[i], sets[j], similarity)
        e = _forest(key, _fp_matrix(t.column("fp").combine_chunks(), bits // 8), distance, coarse, check=check)[0]
        return pa.RecordBatch.from_arrays([pa.array(ids[e[:, j]], pa.int64()) for j in (0, 1)], names=["a", "b"])

    small_batches(rows.sparkSession)
    parts = rows.repartition(F.col("key")).sortWithinPartitions("key", "id")
    return parts.mapInArrow(lambda batches: _by_key(batches, links), "a long, b long")


def _open_pairs(rows: DataFrame, bits: int, distance: int, coarse: tuple[int, int], depth: int) -> DataFrame:
    """Pairs (a, b, far, la, lb) of rows (key, id, fp, label) with equal keys and different labels, within the distance, from `depth` forests a key; a row of nulls if others are left over."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        key, ids, label = (t.column(c).to_numpy() for c in ("key", "id", "label"))
        e, far, _, more = _forest(key, _fp_matrix(t.column("fp").combine_chunks(), bits // 8), distance, coarse, label, depth)
        flip = label[e[:, 0]] > label[e[:, 1]]
        e[flip] = e[flip][:, ::-1]
        cols = [ids[e[:, 0]], ids[e[:, 1]], far, label[e[:, 0]], label[e[:, 1]]]
        out = [pa.array(c, pa.int64()) for c in cols]
        if more:
            out = [pa.concat_arrays([c, pa.nulls(1, pa.int64())]) for c in out]
        return pa.RecordBatch.from_arrays(out, names=["a", "b", "far", "la", "lb"])

    parts = rows.repartition(F.col("key")).sortWithinPartitions("key", "id")
    return parts.mapInArrow(lambda batches: _by_key(batches, pairs), "a long, b long, far long, la long, lb long")


def _with_free(rows: DataFrame, bits: int, words: int, word_bits: int, radius: int) -> DataFrame:
    width = bits // 8
    masks = [m for p in word_positions(bits, words, word_bits) for m in covering_masks(p, radius, bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, key = _fp_matrix(b.column(1), width), b.column(2).to_numpy(zero_copy_only=False)
            free = [bytes(width)] * len(fp)
            for t, m in enumerate(masks):
                hit = _keys(fp, np.zeros(len(fp), np.uint64), np.frombuffer(m, ">u8").astype(np.uint64), t).view(np.int64) == key
                rest = (~np.frombuffer(m, np.uint8)).tobytes()
                free = [rest if h else f for h, f in zip(hit.tolist(), free, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(free, pa.binary())], names=["id", "fp", "key", "free"])

    return rows.select("id", "fp", "key").mapInArrow(run, "id long, fp binary, key long, free binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, bits: int = 64, distance: int = 3, distinct: bool = False, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row (id, fp binary, component_id) per row of docs; component_id is the least id reachable over links, the row's own included.

    Null or empty text: the zero fingerprint, which links like any other. Rows with a null id get their fingerprint and
    the component of other rows with that same fingerprint (null without any), but join no groups themselves. Repeated rows come
    back as often as they came. An empty table gives no rows. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    fps = materialise(spark, fingerprints(docs, id_col, text_col, k, bits, distinct), "fingerprints")
    nodes = materialise(spark, fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    found = components(spark, link(nodes, bits=bits, distance=distance, radius=radius, word_bits=bits, bucket=bucket), "simhash")
    known = nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(known, "fp", "left").select("id", "fp", "component_id")


#: The pipeline's setting: sets of five-word shingles, 1,024 bits, of which the tables hold the first 192 in words of 36 positions. Sets of similarity 0.8
#: are expected to differ in acos(2s / (1 + s)) / pi of the bits: in 29 of 192, give or take 5, and in 155 of 1,024, give or take 11. So pairs beyond 46 or
#: beyond 195 bits are given up; all others are compared by their sets.
SIMILARITY, SHINGLE = 0.8, 5
WIDE = {"bits": 1024, "coarse": (192, 46), "fine": 195, "radius": 3, "words": 9, "word_bits": 36, "bucket": BUCKET}
#: Sets of a group that one task compares.
GROUP_BYTES = 1 << 26


def similar_links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, bits: int = 1024, coarse: tuple[int, int] = (192, 46), fine: int = 195, radius: int = 3, words: int = 9, word_bits: int = 36, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) of similarity or more between nodes (id unique, fp of so many bits); their components are those of all such pairs that meet in a table within coarse and fine bits, whatever the size of a group.

    The tables find pairs by the first bits, and these pairs' components are found. One of at most `bucket` nodes whose sets (which sets(ids) gives) have at
    most GROUP_BYTES goes to one task, where its pairs that share a table's key are compared, nearest first, unless links join them already. Larger ones are never gathered:
    long_links() goes through them key by key, and compares the same pairs.
    """
    spark = nodes.sparkSession
    first = nodes.select("id", F.substring("fp", 1, coarse[0] // 8).alias("fp"))
    found = materialise(spark, link(first, bits=coarse[0], distance=coarse[1], radius=radius, words=words, word_bits=word_bits, bucket=bucket, groups=True), "found")
    near = found.where("far is not null")
    whole = materialise(spark, components(spark, near, "coarse").select(F.col("component").alias("key"), F.col("node").alias("id")), "coarse")
    known = materialise(spark, sets(whole.select("id")), "sets")
    sizes = whole.join(known.select("id", F.octet_length("set").alias("n")), "id").groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("bytes"))
    sizes = materialise(spark, sizes.select("key", ((F.col("members") <= bucket) & (F.col("bytes") <= GROUP_BYTES)).alias("fits")), "coarse-sizes")
    inside = whole.join(sizes.where("fits").select("key"), "key", "left_semi")
    members = found.where("far is null").select(F.col("a").alias("key"), F.col("b").alias("id"))
    met = members.groupBy("id").agg(F.collect_set("key").alias("met"))  # one group at most for each table
    rows = inside.join(nodes.select("id", "fp"), "id").join(known, "id").join(met, "id").select("key", "id", "fp", "set", "met")
    links = materialise(spark, _exact_links(rows, bits, fine, coarse, similarity), "links")
    large = sizes.where("not fits").select("key")
    if large.isEmpty():
        return links
    ids = whole.join(large, "key", "left_semi").select("id")
    groups = members.distinct().join(ids, "id", "left_semi").select("key", "id")
    near = near.join(ids, near.a == ids.id, "left_semi")
    return links.unionByName(long_links(nodes, near, groups, known, similarity, bits, coarse, fine))


def long_links(nodes: DataFrame, near: DataFrame, groups: DataFrame, known: DataFrame, similarity: float, bits: int, coarse: tuple[int, int], fine: int) -> DataFrame:
    """Links of nodes (id, fp) from pairs near (a, b, far) and groups (key, id) of rows that share a key, with known sets (id, set).

    Each node's nearest is compared first. That joins most of every group of copies, and pairs in one component need no comparison. Then, round after
    round, the pairs between components that share a key are compared, nearest first, four times as many a round, until
    none is left that has not been.
    """
    spark, groups = nodes.sparkSession, materialise(nodes.sparkSession, groups, "groups")
    known = known.join(nodes.select("id", "fp"), "id")
    both = near.select(F.col("a").alias("id"), F.struct("far", F.col("b").alias("to")).alias("near"))
    both = both.unionByName(near.select(F.col("b").alias("id"), F.struct("far", F.col("a").alias("to")).alias("near")))
    nearest = both.groupBy("id").agg(F.min("near").alias("near"))
    new = nearest.select(F.least("id", "near.to").alias("a"), F.greatest("id", "near.to").alias("b")).distinct()
    new = materialise(spark, new, "pairs-0")
    tested, links, depth = new, materialise(spark, confirm(new, known, similarity, bits, fine), "links-0"), 1
    while True:
        label = components(spark, links, "simhash").withColumnRenamed("node", "id")
        rows = groups.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
        several = rows.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("key")
        rows = materialise(spark, rows.join(several, "key", "left_semi").join(nodes.select("id", "fp"), "id").select("key", "id", "fp", "label"), f"open-{depth}")
        pairs = materialise(spark, _open_pairs(rows, bits, fine, coarse, depth), f"candidates-{depth}")
        fresh = pairs.where("a is not null").distinct().join(tested, (F.least(pairs.a, pairs.b) == tested.a) & (F.greatest(pairs.a, pairs.b) == tested.b), "left_anti")
        between = Window.partitionBy("la", "lb").orderBy("far", "a", "b")
        fresh = materialise(spark, fresh.withColumn("nth", F.row_number().over(between)), f"fresh-{depth}")
        new = fresh.where(F.col("nth") <= depth).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if fresh.isEmpty():
            if pairs.where("a is null").isEmpty():
                return links
        else:
            links = links.unionByName(materialise(spark, confirm(new, known, similarity, bits, fine), f"links-{depth}"))
            tested = materialise(spark, tested.unionByName(new), f"tested-{depth}")
        depth *= 4


def copies_to_drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = SHINGLE, **how) -> DataFrame:
    """(id, text_hash, keep) of the rows of docs that do not stay as they are: keep is false for rows that go, true for rows that
    are there several times and of which one stays. In each component of near-duplicates the row of the least id stays, null being last, then the least hash of the text.

    Texts with equal fingerprints of all bits are copies: null and empty texts are, and texts that differ in case and white space only.
    """
    spark, how = docs.sparkSession, WIDE | how
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    fps = materialise(spark, fingerprints(rows, "id", "text", k, how["bits"], True, ["text_hash"]), "fingerprints")
    keys = fps.groupBy("fp", "id", "text_hash").agg(F.count("*").alias("n"))
    keys = materialise(spark, keys, "keys")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    nodes = materialise(spark, keys.groupBy("fp").agg(F.min(order).alias("best"), F.count("*").alias("rows")).withColumn("node", F.monotonically_increasing_id()), "nodes")

    def sets(ids: DataFrame) -> DataFrame:
        """Shingle sets of nodes, from the text of each one's best row; once a node where that row is repeated."""
        mine = nodes.join(ids, nodes.node == ids.id, "left_semi").select("node", F.col("best.id").alias("_id"), F.col("best.text_hash").alias("_hash"))
        found = rows.join(mine, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select(F.col("node").alias("id"), "text")
        repeated = keys.where("n > 1").limit(1).isEmpty()
        found = shingle_sets(found, k)
        return found if repeated else found.groupBy("id").agg(F.min("set").alias("set"))

    links = similar_links(nodes.select(F.col("node").alias("id"), "fp"), sets, similarity, **how)
    label = components(spark, links, "simhash").select("node", "component")
    grouped = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = grouped.groupBy("component").agg(F.min("best").alias("stays"), F.sum("rows").alias("members")).where("members > 1")
    crowd = grouped.join(best, "component").select("fp", "stays")
    crowd = keys.join(crowd, "fp").select("id", "text_hash", "n", (F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("text_hash") == F.col("stays.text_hash"))).alias("keep"))
    alone = keys.where("n > 1").join(grouped.join(best, "component", "left_anti").select("fp"), "fp", "left_semi").select("id", "text_hash", "n", F.lit(True).alias("keep"))
    out = crowd.unionByName(alone).where(~F.col("keep") | (F.col("n") > 1))
    return materialise(spark, out.select("id", "text_hash", "keep").distinct(), "copies")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 64-bit SimHash over 3-word shingles differs in 3 bits or fewer."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (copies_to_drop() says which), whole and in its columns.

    Groups are found by fingerprints, but a row only goes if a path of exact comparisons, of similarity 0.8 or more, joins it to the one that stays. Rows without an id
    join groups like others and stay only where all are without. Null and empty texts are copies of each other, repeated rows are
    copies, an empty table stays empty; other columns pass through, whatever their names.
    """
    found = copies_to_drop(docs).withColumnsRenamed({"id": "_copy_id", "text_hash": "_copy_hash", "keep": "_copy_keep"})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_copy_id")) & (F.xxhash64("text") == F.col("_copy_hash"))
    known = docs.join(found, same, "left")
    single = known.where("_copy_keep is null").select(docs.columns)
    if found.where("_copy_keep").isEmpty():
        return single
    return single.unionByName(known.where("_copy_keep").dropDuplicates(["_copy_id", "_copy_hash"]).select(docs.columns))
