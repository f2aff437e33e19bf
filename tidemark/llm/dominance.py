"""Dominance counting: how many points come no later and lie strictly higher, by persistent segment trees in range shards.

Points are put in two orders: by slot (equal slots from the highest level down) and by level (equal levels by slot). A
point counts for another if it comes before it in the first order and lies strictly higher, and then it comes after it in
the second. Ranges of the first order are shards, ranges of the second are bands, both of a bounded number of rows however
many points share a slot or a level. What counts for a point lies either in its own shard, or in an earlier shard and its own band, or
in an earlier shard and a later band. The first two sums come from trees over levels with one version per slot or shard, the last from
histograms by band that earlier shards hand on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructType

from tidemark.llm.common import materialise, table

#: Points of a shard and of a band; more only where the square of the number of shards would pass a sixteenth of the points (beyond 156 million points).
SHARD_ROWS = 50_000


def suffix_sums(version: np.ndarray, level: np.ndarray, weights: np.ndarray, at: np.ndarray, above: np.ndarray) -> np.ndarray:
    """For each query (at, above) the sums of weights (one column each) over points with version <= at and level > above.

    A persistent segment tree over the ranks of levels: what a version adds copies the nodes on its paths, and a copy points to
    the latest earlier version of the child that it does not change. Nodes of one depth are sorted by (prefix, version), so the
    copies of a depth are one array, and the tree is built and walked from the roots down with two depths in memory.
    """
    out = np.zeros((len(at), weights.shape[1]), np.int64)
    if not len(version) or not len(at):
        return out
    levels, rank = np.unique(level, return_inverse=True)
    versions, time = np.unique(version, return_inverse=True)
    height, steps = int(len(levels) - 1).bit_length(), len(versions)

    def copies(depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys (prefix, version) of the nodes of a depth, and the sums below each: of all that was added up to its version."""
        keys, where = np.unique((rank >> (height - depth)) * steps + time, return_inverse=True)
        sums = np.zeros((len(keys), weights.shape[1]), np.int64)
        for j in range(weights.shape[1]):
            np.add.at(sums[:, j], where, weights[:, j])
        sums = np.cumsum(sums, axis=0)
        first = np.searchsorted(keys, keys // steps * steps)
        return keys, sums - np.where(first[:, None] > 0, sums[first - 1], 0)

    want = np.searchsorted(levels, above, side="right")  # the suffix of ranks that counts
    root = np.searchsorted(versions, at, side="right") - 1
    keys, sums = copies(0)
    left = np.flatnonzero((root >= 0) & (want < len(levels)))
    node = root[left]  # version number = position of its root
    for depth in range(height):
        below, below_sums = copies(depth + 1)
        prefix, when = np.divmod(keys, steps)
        child = []
        for side in (0, 1):
            k = np.searchsorted(below, (2 * prefix + side) * steps + when, side="right") - 1
            child.append(np.where((k >= 0) & (below[k] // steps == 2 * prefix + side), k, -1))
        bit = want[left] >> (height - 1 - depth) & 1
        right = child[1][node]
        whole = np.flatnonzero((bit == 0) & (right >= 0))  # the suffix has all of the right child
        out[left[whole]] += below_sums[right[whole]]
        node = np.where(bit == 1, right, child[0][node])
        left, node = left[node >= 0], node[node >= 0]
        keys, sums = below, below_sums
    out[left] += sums[node]
    return out


def _task(answer: Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gathers a whole task (a range of bounded size) and adds or replaces long columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        columns = {n: rows.column(n).to_numpy() for n in names}
        for name, values in answer(columns, TaskContext.get().partitionId()).items():
            column = pa.chunked_array([pa.array(values, pa.int64())])
            k = rows.schema.get_field_index(name)
            rows = rows.append_column(name, column) if k < 0 else rows.set_column(k, rows.schema.field(k), column)
        yield from rows.to_batches(max_chunksize=10_000)

    return run


def _with_longs(schema: StructType, *names: str) -> StructType:
    out = StructType(list(schema))
    for n in names:
        if n not in schema.names:
            out = out.add(n, LongType())
    return out


COLUMNS = ["slot", "level", "n", "rows"]


def _count(points: DataFrame, shard_rows: int) -> DataFrame:
    """points (slot, level, n, rows, tie, and more columns) with n_above and rows_above: sums of n and rows over the points before and above."""
    spark = points.sparkSession
    total = points.count()
    shards = max(1, -(-total // max(shard_rows, int(4 * total**0.5))))

    def in_shard(c: dict[str, np.ndarray], part: int) -> dict[str, np.ndarray]:
        got = suffix_sums(c["slot"], c["level"], np.stack([c["n"], c["rows"]], 1), c["slot"], c["level"])
        return {"shard": np.full(len(got), part, np.int64), "n_above": got[:, 0], "rows_above": got[:, 1]}

    def carried(c: dict[str, np.ndarray], part: int) -> dict[str, np.ndarray]:
        got = suffix_sums(c["shard"], c["level"], np.stack([c["n"], c["rows"]], 1), c["shard"] - 1, c["level"])
        return {"n_above": c["n_above"] + got[:, 0], "rows_above": c["rows_above"] + got[:, 1], "band": np.full(len(got), part, np.int64)}

    schema = _with_longs(points.schema, "shard", "n_above", "rows_above")
    dealt = points.repartitionByRange(shards, "slot", F.desc("level"), "tie")
    ranged = materialise(spark, dealt.mapInArrow(_task(in_shard, COLUMNS), schema), "shards")
    banded = ranged.repartitionByRange(shards, "level", "slot", "tie").mapInArrow(_task(carried, [*COLUMNS, "shard", "n_above", "rows_above"]), _with_longs(schema, "band"))
    banded = materialise(spark, banded, "bands")
    # Whole bands of earlier shards: a histogram by shard and band, made dense, summed over later bands of a shard, then over earlier shards of a band.
    squares = banded.groupBy("shard", "band").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    last = squares.agg(F.max("band")).first()[0]
    none = F.lit(0).cast("long")
    empty = squares.select("shard").distinct().select("shard", F.explode(F.sequence(none, F.lit(last or 0).cast("long"))).alias("band"), none.alias("n"), none.alias("rows"))
    dense = squares.unionByName(empty).groupBy("shard", "band").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    later = Window.partitionBy("shard").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("band").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dense = dense.select("shard", "band", F.sum("n").over(later).alias("n"), F.sum("rows").over(later).alias("rows"))
    dense = dense.select("shard", "band", F.sum("n").over(earlier).alias("more_n"), F.sum("rows").over(earlier).alias("more_rows"))
    out = banded.join(dense.hint("merge"), ["shard", "band"])
    return out.withColumns({c: F.col(c) + F.coalesce(more, none) for c, more in (("n_above", F.col("more_n")), ("rows_above", F.col("more_rows")))}).drop("shard", "band", "more_n", "more_rows")


def count_above(df: DataFrame, slot: Column, level: Column, rows: Column, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """df with slot, level (long), n_above and rows_above: how many rows of df come no later (slot <= its own) and lie strictly
    higher (level > its own), and the sum of rows over these.

    Rows with a null slot or level count for none and have null counts; rows must not be null. Repeated rows count each. All other columns
    stay; columns of the four names are replaced. An empty table gives none. No task gets more than a range of about shard_rows rows (or 4 times
    the root of the number of points, if that is more, so that sums of whole squares stay few), nothing is broadcast and nothing goes to the driver but
    samples for the ranges. Equal rows, slots and levels are dealt apart by a number that each row gets in a stored table.
    """
    keep = [c for c in df.columns if c not in ("slot", "level", "n_above", "rows_above")]
    points = df.select(F.struct(*keep).alias("row"), slot.cast("long").alias("slot"), level.cast("long").alias("level"), F.lit(1).cast("long").alias("n"), rows.cast("long").alias("rows"))
    stored = materialise(df.sparkSession, points.withColumn("tie", F.monotonically_increasing_id()), "points")
    known = F.col("slot").isNotNull() & F.col("level").isNotNull()
    out = ["row.*", "slot", "level", "n_above", "rows_above"]
    none = F.lit(None).cast("long")
    counted = _count(stored.where(known), shard_rows).select(*out)
    return counted.unionByName(stored.where(~known).withColumns({"n_above": none, "rows_above": none}).select(*out))


def hour_slot(at: Column, kind: DataType) -> Column:
    """Hours since 1970 of a timestamp without a zone, or of one with a zone in UTC, whatever the session's zone is."""
    if kind.typeName() == "timestamp":
        return F.floor(F.unix_micros(at) / F.lit(3_600_000_000).cast("decimal(20,0)"))
    return F.date_diff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(at)


def level_of(total: Column) -> Column:
    """floor(floor(100 total + 0.5) / 100) in doubles; null if total is null or no number that a long can hold."""
    x = F.floor(F.floor(F.lit(100.0) * total + F.lit(0.5)).cast("double") / F.lit(100.0))
    return F.when(F.abs(total) < F.lit(9e16), x)


def op12_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales")
    at, total = sales.schema["sold_at"].dataType, F.col("total").cast("double")
    stands = F.lit(1) + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % 2
    out = count_above(sales.select("sale_id", "sold_at", "total"), hour_slot(F.col("sold_at"), at), level_of(total), stands)
    return out.select("sale_id", "slot", "level", F.col("n_above").alias("n_sales"), F.col("rows_above").alias("n_rows"))


#: CRC-32 of the decimal digits, bit by bit; the count is a join of the distinct (slot, level) pairs.
OP12_SQL = """
with recursive bits(k, v, j) as (
    select range, range, 0 from range(256) union all
    select k, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, j + 1 from bits where j < 8),
steps as (select list(v order by k) as t from bits where j = 8),
points as (
    select sale_id, cast(floor(epoch_us(sold_at) / 3600000000.0) as bigint) as slot,
        cast(floor(floor(100.0::double * total + 0.5::double) / 100.0::double) as bigint) as level,
        1 + xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(sale_id::varchar, ''), lambda x: ascii(x)::bigint)),
            lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295::bigint) % 2 as stands
    from sales, steps),
cells as (select slot, level, count(*) as n, sum(stands) as rows from points where slot is not null and level is not null group by all),
above as (
    select a.slot, a.level, coalesce(sum(b.n), 0) as n_sales, coalesce(sum(b.rows), 0) as n_rows
    from cells a left join cells b on b.slot <= a.slot and b.level > a.level group by all)
select p.sale_id, p.slot, p.level, n_sales::bigint as n_sales, n_rows::bigint as n_rows
from points p left join above a on a.slot = p.slot and a.level = p.level
"""
