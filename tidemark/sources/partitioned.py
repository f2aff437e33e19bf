"""A partitioned table that is rewritten only where its content has changed.

Beside the data lies a manifest: for each partition the number of rows and a signature that the order of rows does not change. A write compares
signatures, overwrites the partitions that differ, removes those that are gone, and stores the next manifest last: a write that fails
in between is made good by the next, which finds the old signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"
#: Rows in a file at most; a partition with more has several files.
FILE_ROWS = 20_000_000


def row_number_of(columns: list[str]) -> Column:
    """60 bits of a row's MD5; nulls differ from empty texts, and fields cannot run into each other, since each comes with its length."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def signatures(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, signature) of every partition: the sum of the rows' numbers, so equal rows count as often as they come, in whatever order."""
    columns = sorted(c for c in df.columns if c not in by)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(row_number_of(columns).cast("decimal(38,0)")).cast("decimal(38,0)").alias("signature"))


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _latest(spark: SparkSession, path: str) -> int:
    """The greatest version whose manifest was written to its end; -1 without any."""
    files, at = _hadoop(spark, f"{path}/{MANIFEST}")
    if not files.exists(at):
        return -1
    done = [s.getPath().getName() for s in files.listStatus(at) if files.exists(_hadoop(spark, f"{s.getPath()}/_SUCCESS")[1])]
    return max((int(n[1:]) for n in done if n.startswith("v")), default=-1)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(by, rows, signature) of what the table holds; None before its first write."""
    version = _latest(spark, path)
    return None if version < 0 else spark.read.option("basePath", f"{path}/{MANIFEST}/v{version}").parquet(f"{path}/{MANIFEST}/v{version}")


def write_changed(df: DataFrame, path: str, by: list[str]) -> list[tuple[str, tuple]]:
    """Makes the table at path equal to df. Returns what was done, ("written" or "removed", values of by) for each partition touched: nothing, and no file touched, where contents are equal.

    df is read for signatures and, if something differs, for the rows of the partitions that do. Partitions must be few enough to be listed (months, not keys); their values are text, numbers or dates, not null.
    """
    spark = df.sparkSession
    now = signatures(df, by).withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
    before = manifest(spark, path)
    keys = [f"_k{i}" for i in range(len(by))]
    if before is None:
        todo = [("written", tuple(r[k] for k in keys)) for r in now.collect()]
        change = None
    else:
        old = before.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(by)), F.col("rows").alias("_rows"), F.col("signature").alias("_signature"))
        both = now.join(old, [F.col(f"_k{i}") == F.col(f"_o{i}") for i in range(len(by))], "full").where("not (rows <=> _rows and signature <=> _signature)")
        kind = F.when(F.col("rows").isNull(), "removed").otherwise("written")
        rows = both.select(kind.alias("kind"), *(F.coalesce(f"_k{i}", f"_o{i}").alias(k) for i, k in enumerate(keys))).collect()
        todo = [(r.kind, tuple(r[k] for k in keys)) for r in rows]
        if not todo:
            return []
        schema = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by))).schema
        change = spark.createDataFrame([v for k, v in todo if k == "written"], schema)
    some = df if change is None else df.join(change, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(by)], "left_semi")
    if any(k == "written" for k, _ in todo):
        out = some.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS)
        out.partitionBy(*by).parquet(path)
    for kind, values in todo:
        if kind == "removed":
            files, at = _hadoop(spark, "/".join([path, *(f"{c}={v}" for c, v in zip(by, values))]))
            files.delete(at, True)
    signatures(df, by).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}/v{_latest(spark, path) + 1}")  # a row for each partition
    return sorted(todo)


def files_by(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """(by, file) of the data files, for audits."""
    return spark.read.parquet(path).select(*by, F.input_file_name().alias("file")).distinct()
