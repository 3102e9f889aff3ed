"""Annotation of document streams, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.model import settle


def annotate_stream(docs: DataFrame, steps: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True):
    """Run a chain of per-document steps over each micro-batch and append the result as Parquet, one folder a batch.

    A batch that is run again after a failure overwrites its own folder, so no row comes twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        settle(batch.sparkSession)
        steps(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def tumbling(events: DataFrame, width: str, by: str, late: str | None = None) -> DataFrame:
    """Number and sum of `value` in windows of fixed width; late: how long late rows are waited for (streams)."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.select(by, "n", "first_ts", "last_ts")
