"""Splits by time and by hash, their guards, and samples that survive repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a row's hash by which random_split deals rows into sorting tasks: 65,536 counts are a small broadcast, and 10^11 rows make groups of 1.5 million.
DIGITS = 4


class FinalTestLeak(ValueError):
    """Rows of the final test reached an operator that learns or chooses."""


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def with_split(df: DataFrame, time_col: str, train_until: str, validation_until: str) -> DataFrame:
    """Adds split: train before train_until, validation before validation_until, else test. Bounds are exclusive, so no instant falls between."""
    t = F.col(time_col)
    return df.withColumn("split", F.when(t < ntz(train_until), "train").when(t < ntz(validation_until), "validation").when(t.isNotNull(), "test"))


def time_split(df: DataFrame, time_col: str, train_until: str, validation_until: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three filtered frames: each filter reaches the scan."""
    t = F.col(time_col)
    return df.where(t < ntz(train_until)), df.where((t >= ntz(train_until)) & (t < ntz(validation_until))), df.where(t >= ntz(validation_until))


def split_summary(df: DataFrame, time_col: str) -> DataFrame:
    """(split, n, start, end, years) of a frame with split."""
    return df.groupBy("split").agg(F.count("*").alias("n"), F.min(time_col).alias("start"), F.max(time_col).alias("end"), F.array_join(F.array_sort(F.collect_set(F.year(time_col))), ",").alias("years"))


def assert_disjoint(df: DataFrame, time_col: str, order: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """The summary, once no split is empty and each ends before the next begins (so none share a time)."""
    rows = {r.split: r for r in split_summary(df, time_col).collect()}
    for name in order:
        if name not in rows:
            raise AssertionError(f"the split {name} is empty")
    for a, b in zip(order, order[1:], strict=False):
        if not rows[a].end < rows[b].start:
            raise AssertionError(f"{a} ends at {rows[a].end}, {b} begins at {rows[b].start}")
    return split_summary(df, time_col)


def overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in both."""
    return left.select(*keys).intersect(right.select(*keys))


def assert_no_final_test(df: DataFrame, time_col: str, cut: str, where: str = "") -> DataFrame:
    """df itself; raises FinalTestLeak if a row is not before the cut. Empty frames and null times pass."""
    if not df.where(F.col(time_col) >= ntz(cut)).limit(1).isEmpty():
        raise FinalTestLeak(f"{where or 'frame'} holds rows from {cut} on")
    return df


def hash_order(keys: list[str], seed: int) -> Column:
    """An order that only the seed and the row's key decide."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).cast("binary"))


def random_split(df: DataFrame, keys: list[str], seed: int, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Adds split with exact counts, int(n * share), in hash order; only to show how optimistic random splits are.

    The rank is found without sorting all rows in one task: rows are counted by the first DIGITS hex digits of their hash,
    running sums over those 65,536 counts give each prefix its first rank, and ranks within a prefix are added.
    """
    df = df.withColumn("_h", hash_order(keys, seed)).withColumn("_p", F.substring("_h", 1, DIGITS))
    counts = df.groupBy("_p").agg(F.count("*").alias("_c"))
    all_rows = Window.partitionBy(F.lit(0))
    counts = counts.select("_p", (F.sum("_c").over(all_rows.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(all_rows).alias("_n"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_h", *keys))
    out = df.join(F.broadcast(counts), "_p").withColumn("_r", rank)  # at most 16 ** DIGITS rows
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * validation)
    return out.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= a + b, "validation").otherwise("test")).drop("_h", "_p", "_before", "_n", "_r")


def hash_ranks(df: DataFrame, keys: list[str], seeds: tuple[int, ...] = (), parts: list[str] = ()) -> DataFrame:
    """df with _rank, from 1 in hash order within each part, and _total, the part's rows: for all parts at once. With seeds each row comes once for each, with
    the column seed, which is a part of its own; without, df has that column. Parts must be few: their counts by prefix (16 ** DIGITS each) are broadcast.
    """
    if seeds:
        df = df.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))))
    parts = ["seed", *parts]
    df = df.withColumn("_h", F.md5(F.concat_ws("|", F.col("seed").cast("string"), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)).cast("binary"))).withColumn("_p", F.substring("_h", 1, DIGITS))
    part = Window.partitionBy(*parts)
    counts = df.groupBy(*parts, "_p").agg(F.count("*").alias("_c"))
    counts = counts.select(*parts, "_p", (F.sum("_c").over(part.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(part).alias("_total"))
    out = df.join(F.broadcast(counts), [*parts, "_p"])
    return out.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*parts, "_p").orderBy("_h", *keys))).drop("_h", "_p", "_before")


def split_of_rank(train: float = 0.7, validation: float = 0.15) -> Column:
    """The split of a row by its _rank of _total: the counts of random_split."""
    a, b = F.floor(F.col("_total") * train), F.floor(F.col("_total") * validation)
    return F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= a + b, "validation").otherwise("test")


def sample_rows(df: DataFrame, keys: list[str], seed: int, n: int) -> DataFrame:
    """The n rows of the least hashes."""
    return df.withColumn("_h", hash_order(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h")


def rolling_folds(df: DataFrame, time_col: str, cuts: list[str], until: list[str]) -> DataFrame:
    """Each row with the folds that it belongs to, as role train (before the cut) or test (from the cut to its end): expanding windows."""
    t = F.col(time_col)
    folds = F.array(*(F.struct(F.lit(i).alias("fold"), F.when(t < ntz(a), "train").when(t < ntz(b), "test").alias("role")) for i, (a, b) in enumerate(zip(cuts, until, strict=True))))
    return df.select("*", F.explode(F.filter(folds, lambda x: x["role"].isNotNull())).alias("_f")).select(*df.columns, "_f.fold", "_f.role")


def complete_rows(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without nulls in the columns, and one row: before, after and the share kept in percent."""
    full = F.lit(True)
    for c in columns:
        full &= F.col(c).isNotNull()
    stats = df.agg(F.count("*").alias("n_before"), F.count_if(full).alias("n_after"), (100.0 * F.count_if(full) / F.nullif(F.count("*"), F.lit(0))).alias("kept_pct"))
    return df.where(full), stats
