"""Structured Streaming forms: deduplicated windows, sessions, and findings merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(stream: DataFrame, ts: str, keys: list[str], row_id: str, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows per window and key; redelivered rows within the watermark count once, later ones than that are dropped by it."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([row_id])
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return s.groupBy(w.alias("window"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return s.groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count("*").alias("n")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def merge_batches(stream: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], step: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str):
    """Runs ``step(state, batch)`` for every micro-batch and writes the new state under the batch's number, so a repeated batch overwrites itself."""

    def run(batch: DataFrame, number: int) -> None:
        write(step(read(), batch), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
