"""Structured Streaming counterparts: windowed counts, idempotent upserts, keyed resume, and a stateful sampler.

The same functions work on batch and streaming DataFrames where Spark allows it, so batch results check streaming ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """``event_type, hour, n, total`` in tumbling windows; late rows are dropped beyond the watermark of a stream."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy("event_type", F.window("at", "1 hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``user_id, start, end, n`` of sessions that a gap ends."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_into(path: str, key: str, order: str):
    """A ``foreachBatch`` function that keeps the last row per key under ``path``: a batch that is run again changes nothing.

    Batches are folders named by their number; ``current`` reads the row of each key that is last in ``order`` from all of them, whatever batch it came with.
    """

    def keep(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keep


def current(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("batch"))).alias("_r")).select(key, "_r.*")


def sample_by_interval(events: DataFrame, seconds: float) -> DataFrame:
    """Events that are due: per user one, then the next that comes ``seconds`` or more after it. The due time is kept as state."""

    def due(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        wanted = state.get[0] if state.exists else float("-inf")
        kept = []
        for t, i in zip(rows.ts.astype("int64") / 1e6 if str(rows.ts.dtype).endswith("us]") else rows.ts.astype("datetime64[us]").astype("int64") / 1e6, rows.event_id):
            if t >= wanted:
                kept.append(i)
                wanted = t + seconds
        state.update((wanted,))
        yield pd.DataFrame({"user_id": [key[0]] * len(kept), "event_id": kept}, dtype="int64")

    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(due, "user_id LONG, event_id LONG", "wanted DOUBLE", "append", GroupStateTimeout.NoTimeout)
