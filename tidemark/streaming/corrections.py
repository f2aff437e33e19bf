"""Windows that are corrected when late rows come, and a sink in which a batch that is run again changes nothing.

The stream keeps each window's counts of values and labels as state and emits the window anew whenever a batch adds to it. Each batch's
rows go to a folder of its own, which a second run of the batch overwrites with the same rows; the table is each window's row of its latest batch.
So it equals the batch collapse of all rows that came, once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "values array<double>, counts array<long>, labels array<string>, label_counts array<long>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _added(known: list, counts: list, new: pd.Series) -> tuple[list, list]:
    """Counts by value with those of new rows; nulls are left out."""
    both = pd.Series(counts, index=known, dtype="int64").add(new.dropna().value_counts(), fill_value=0).astype("int64").sort_index()
    return both.index.tolist(), both.tolist()


def _median(values: list[float], counts: list[int]) -> float | None:
    n, seen, found = sum(counts), 0, []
    for v, c in zip(values, counts, strict=True):
        for rank in ((n - 1) // 2, n // 2)[len(found) :]:
            if rank < seen + c:
                found.append(v)
        seen += c
        if len(found) == 2:
            return (found[0] + found[1]) / 2
    return None


class Corrected(StatefulProcessor):
    """A window's row after each batch that adds to it. State holds the window's distinct values with their counts, and goes once the watermark has passed its end by the stream's delay."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", STATE + ", n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else ([], [], [], [], 0)
        values, counts, labels, label_counts, n = (list(x) if not isinstance(x, int) else x for x in held)
        if not n:
            self.handle.registerTimer(int(key[1]))
        for chunk in rows:
            n += len(chunk)
            values, counts = _added(values, counts, chunk["value"])
            labels, label_counts = _added(labels, label_counts, chunk["label"])
        self.state.update((values, counts, labels, label_counts, n))
        mode = min(zip(labels, label_counts, strict=True), key=lambda x: (-x[1], x[0]), default=("", 0))[0]
        total = float(sum(v * c for v, c in zip(values, counts, strict=True))) if values else None
        yield pd.DataFrame({"start_us": [key[0]], "n": [n], "median": [_median(values, counts)], "total": [total], "label_mode": [mode], "label_set": ["; ".join(labels)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def corrected_windows(stream: DataFrame, time_col: str, delay: str, width: str, label: str, value: str) -> DataFrame:
    """(start, n, median, total, label_mode, label_set) of each window that a batch changes. Rows later than the delay behind the latest time are dropped, as their windows' state is gone; rows without a time too."""
    rows = stream.where(F.col(time_col).isNotNull()).select(F.col(time_col).cast("timestamp").alias("t"), F.col(label).alias("label"), F.col(value).cast("double").alias("value"))
    window = F.window("t", width)
    rows = rows.withWatermark("t", delay).withColumns({"start_us": F.unix_micros(window["start"]), "end_ms": F.unix_millis(window["end"])})  # numbers: no zone of a worker can move them
    schema = "start_us long, n long, median double, total double, label_mode string, label_set string"
    out = rows.groupBy("start_us", "end_ms").transformWithStateInPandas(Corrected(), schema, "Update", "EventTime")
    return out.select(F.timestamp_micros("start_us").alias("start"), "n", "median", "total", "label_mode", "label_set")


def merge(batch: DataFrame, batch_id: int, path: str) -> None:
    """One batch into the sink: its folder is overwritten whole, so running it again leaves the same rows."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table: of each window the row of its latest batch."""
    rows = spark.read.option("basePath", path).parquet(path)
    best = rows.groupBy("start").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), "batch").alias("row"))
    return best.select("row.*")


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Arbitrary state needs a store that holds several columns; what was set before holds again afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_corrections(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes all that there is and stops. A batch that failed after it wrote is run again from the checkpoint and overwrites its own folder."""
    with _rocksdb(stream.sparkSession):
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, k: merge(df, k, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
