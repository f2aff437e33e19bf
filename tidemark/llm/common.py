"""What the operators of this subpackage share: tables, the shared folder, Arrow batches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch that goes to a Python worker. Texts can be long, so a batch must stay small.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what a Python worker holds at once: 16 MB or one row of whole texts, not Spark's default of 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs that run inside; what was set before holds again afterwards, after a failed job too."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which tidemark.session sets for local sessions. Where it is unset the operators refuse to run: a machine's own folder would not be shared."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        raise RuntimeError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
    if ":" not in at.split("/")[0]:  # a bare path lies in Spark's default file system
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(at)
        at = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if at.startswith("file:/") and not at.startswith("file://"):
        at = f"file://{at.removeprefix('file:')}"
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> None:
    """Removes all that this application has stored in the shared folder. Results that still read from there must have been written before."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialise(spark: SparkSession, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, so a lost executor costs no more than the tasks after it."""
    path = new_folder(spark, name)
    schema = df.schema
    df.write.parquet(path, compression=codec)
    return spark.read.schema(schema).parquet(path)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x if x is not None else b"" for x in column.to_pylist()]


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a long, b long): one row (node, component) per node of an edge, component being its least node.

    Each round every node moves to the neighbour of the least hash (itself included) and the edges are mapped
    along, made distinct and freed of loops. Hashes change from round to round, so that a long path shrinks by a
    constant factor too. Minima are aggregated before the shuffle, and a hub's rows meet its new name in a sort-merge join
    whose large partitions AQE can split: no node's neighbours are gathered in one place.
    """
    left = materialise(spark, edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges-0")
    moved = None
    for k in range(1, 200):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.xxhash64(F.lit(k), F.col(c))
        near = both.groupBy("a").agg(F.min(F.struct(order("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        move = near.select(F.col("a").alias("node"), F.least(F.col("m"), F.struct(order("a").alias("h"), F.col("a").alias("to")))["to"].alias("to"))
        move = materialise(spark, move, f"{name}-move-{k}")
        by = lambda c: move.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        left = left.join(by("a"), "a").join(by("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        left = left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = materialise(spark, left, f"{name}-edges-{k}")
        if moved is None:
            moved = move
        else:
            step = move.select(F.col("node").alias("to"), F.col("to").alias("next"))
            moved = moved.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
            moved = materialise(spark, moved, f"{name}-moved-{k}")
    else:
        raise RuntimeError("components did not settle")
    if moved is None:
        return spark.createDataFrame([], "node long, component long")
    least = moved.groupBy("to").agg(F.min("node").alias("component"))
    return moved.join(least, "to").select("node", "component")
