"""The folder that driver and executors share, for what a plan writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A path that is used once, under spark.checkpoint.dir, which tidemark.session sets for local sessions; where it is unset there is none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        raise RuntimeError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
    return f"{at.rstrip('/')}/tidemark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: what several branches of a plan read is computed once, and a lost executor costs no more than the tasks after it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all that this application has stored there. Results that still read it must have been written before."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/tidemark/{context.applicationId}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
