"""Streams: rules over arriving files, documents ingested once per content, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Event, Triggers


def watch(spark: SparkSession, path: str, schema: str, kind: str = "csv", **options: object) -> DataFrame:
    """Files as they arrive in a folder."""
    return spark.readStream.schema(schema).options(**({"header": True} if kind == "csv" else {}) | options).format(kind).load(path)


def on_batches(stream: DataFrame, table: str, triggers: Triggers, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None):
    """Fires ``on_ingest`` for every micro-batch, then the sink. The batch id makes a repeated batch known to the sink."""

    def run(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            triggers.fire(Event(f"batch-{batch:09d}", "on_ingest", table, {"row_count": df.count()}), df)
            if sink is not None:
                sink(df, batch)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def once_per_content(stream: DataFrame, text_col: str, at_col: str, delay: str = "1 day") -> DataFrame:
    """Drops texts that arrived before, within the watermark."""
    return stream.withColumn("content_hash", F.sha2(F.coalesce(text_col, F.lit("")), 256)).withWatermark(at_col, delay).dropDuplicatesWithinWatermark(["content_hash"])


def tumbling(events: DataFrame, at_col: str, size: str, *keys: str, value: str | None = None, delay: str | None = None) -> DataFrame:
    """Counts, and sums of ``value``, per window and keys; for batches and streams alike. An extension."""
    return _windowed(events, F.window(at_col, size), keys, value, at_col, delay)


def sliding(events: DataFrame, at_col: str, size: str, step: str, *keys: str, value: str | None = None, delay: str | None = None) -> DataFrame:
    return _windowed(events, F.window(at_col, size, step), keys, value, at_col, delay)


def sessions(events: DataFrame, at_col: str, gap: str, *keys: str, value: str | None = None, delay: str | None = None) -> DataFrame:
    return _windowed(events, F.session_window(at_col, gap), keys, value, at_col, delay)


def _windowed(events, window, keys, value, at_col, delay):
    if delay is not None:
        events = events.withWatermark(at_col, delay)
    made = [F.count(F.lit(1)).alias("n")] + ([F.round(F.sum(value), 4).alias("total")] if value else [])
    grouped = events.groupBy(window.alias("w"), *keys).agg(*made)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *(["n"] + (["total"] if value else [])))
