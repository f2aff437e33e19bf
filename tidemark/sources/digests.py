"""Digests of files of any size: byte ranges are read side by side, and a tree of their digests stands for the file.

A file is cut into ranges of `size` bytes and each range has its SHA-256; Spark's reader passes over empty files, which have no rows here. Every `fanout` digests, in order and as hex
text, make one of the level above, until one is left, the root. What is recorded names the ranges that have changed since.
Whole-file SHA-256, which has no such ranges, is streamed by one task a file. No task holds more than STEP bytes of a file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, digests of a node, bytes that are read at once.
SIZE, FANOUT, STEP = 64 << 20, 256, 1 << 20


def opened(path: str) -> BinaryIO:
    """A file by the path that Spark lists (file:/x, s3://bucket/x), to be read at any place."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    host, _, inside = rest.lstrip("/").partition("/")
    system, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system.open_input_file(f"{root.rstrip('/')}/{inside}")


def _sha256(f: BinaryIO, left: int) -> str:
    h = hashlib.sha256()
    while left:
        data = f.read(min(STEP, left))
        if not data:
            raise OSError("the file has become shorter while it was read")
        h.update(data)
        left -= len(data)
    return h.hexdigest()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length) of the files at the path, a file or a folder with all that is below it; name is relative to the folder. Contents are not read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.when(F.col("path").startswith(root + "/"), F.substring("path", len(root) + 2, 1 << 30)).otherwise(F.element_at(F.split("path", "/"), -1))
    return files.select("path", name.alias("name"), "length")


def _read(rows: DataFrame, tasks: int | None) -> DataFrame:
    """rows (path, start, bytes and more) with the SHA-256 of that range; read in so many tasks, 4 a core if it is not given."""
    n = tasks or 4 * rows.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, start, left in zip(*(b.column(c).to_pylist() for c in ("path", "start", "bytes")), strict=True):
                with opened(path) as f:
                    f.seek(start)
                    out.append(_sha256(f, left))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "sha256"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sha256 string"
    return rows.repartition(n, "path", "start").mapInArrow(run, schema)  # names and numbers are shuffled, no content


def ranges(spark: SparkSession, path: str, size: int = SIZE, tasks: int | None = None) -> DataFrame:
    """(name, n_ranges, part, start, bytes, sha256) of every range of every file at the path. No file: no rows."""
    n = F.ceil(F.col("length") / size).alias("n_ranges")
    rows = listed(spark, path).select("*", n).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_ranges") - 1))).withColumn("start", F.col("part") * size)
    return _read(rows.select("path", "name", "n_ranges", "part", "start", F.least(F.lit(size), F.col("length") - F.col("start")).alias("bytes")), tasks).drop("path")


def roots(of: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(name, bytes, n_ranges, root) of stored ranges(); a file of one range has that range's digest as its root. No row gathers more than fanout digests."""
    nodes, most = of.select("name", "n_ranges", "part", "bytes", "sha256", F.col("n_ranges").alias("left")), of.agg(F.max("n_ranges")).first()[0] or 1
    while most > 1:
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda d: d.sha256), ""), 256)
        up = nodes.groupBy("name", "n_ranges", "left", F.floor(F.col("part") / fanout).alias("up")).agg(joined.alias("joined"), F.min("sha256").alias("same"), F.sum("bytes").alias("bytes"))
        nodes = up.select("name", "n_ranges", F.col("up").alias("part"), "bytes", F.when(F.col("left") == 1, F.col("same")).otherwise(F.col("joined")).alias("sha256"), F.ceil(F.col("left") / fanout).alias("left"))
        most = -(-most // fanout)
    return nodes.select("name", "bytes", "n_ranges", F.col("sha256").alias("root"))


def record(spark: SparkSession, path: str, at: str, size: int = SIZE) -> DataFrame:
    """Stores the ranges of the path as Parquet in `at`, which must not lie in it, and returns them as stored."""
    ranges(spark, path, size).write.parquet(at)
    return recorded(spark, at)


def recorded(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema("name string, n_ranges long, part long, start long, bytes long, sha256 string").parquet(at)


def altered(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, part, start, status) of the ranges that differ between two recordings of the same range size: altered (other bytes, a shorter or longer last range), added, or
    removed. Files are told by name, so a folder that has moved as a whole has none; a renamed file is removed and added."""
    sides = [df.select("name", "part", "start", F.col("sha256").alias(s)) for df, s in ((before, "was"), (after, "now"))]
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("altered")
    return sides[0].join(sides[1], ["name", "part", "start"], "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("name", "part", "start", status.alias("status"))


def verify(spark: SparkSession, path: str, at: str, size: int = SIZE, show: int = 10) -> None:
    """Raises ValueError, which names the first ranges, unless the path holds what was recorded in `at` with this range size."""
    wrong = altered(recorded(spark, at), ranges(spark, path, size)).orderBy("name", "part").limit(show).collect()
    if wrong:
        raise ValueError(f"{path} has changed: " + ", ".join(f"{r.name} from byte {r.start} {r.status}" for r in wrong))


def streamed_sha256(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """(name, bytes, sha256) of each file as a whole; the bytes of one file go through one task in turn, as SHA-256 demands, in little memory."""
    return _read(listed(spark, path).select("path", "name", F.lit(0).cast("long").alias("start"), F.col("length").alias("bytes")), tasks).select("name", "bytes", "sha256")
