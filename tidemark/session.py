"""Session settings and the loader of tables."""

from __future__ import annotations

import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own, with spark.checkpoint.dir set. Here a folder of this machine does, unless the environment's Spark settings name one."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if not SparkConf().get("spark.checkpoint.dir", None):
        conf["spark.checkpoint.dir"] = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
