"""Windowed aggregates of timed rows, for batches and streams alike, and rolling state with a lifetime."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tumbling(rows: DataFrame, time: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Rows a window and key; on a stream, ``late`` is how long state waits for late rows."""
    rows = rows.withWatermark(time, late) if late else rows
    out = rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("window_start"), "n")


def sessions(rows: DataFrame, key: str, time: str, order: str, gap_seconds: int) -> DataFrame:
    """Runs of a key's rows with no gap longer than ``gap_seconds``: number, start and size."""
    by = W.partitionBy(key).orderBy(time, order)
    gap = F.timestamp_diff("MICROSECOND", F.lag(time).over(by), F.col(time)) > gap_seconds * 1_000_000
    numbered = rows.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("long"))
    numbered = numbered.withColumn("session_no", F.sum("_new").over(by))
    return numbered.groupBy(key, "session_no").agg(F.min(time).alias("session_start"), F.count("*").alias("n"))


def upsert_counts(spark, stream: DataFrame, key: str, name: str):
    """A running count of a stream's keys as a memory table. A memory sink keeps what it is sent, so it takes complete mode, which
    sends all keys each time: for stores that take upserts use update mode, as ``upsert_to`` does."""
    return stream.groupBy(key).agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).start()


def upsert_to(stream: DataFrame, key: str, write, checkpoint: str):
    """A running count of a stream's keys; each batch's changed keys (key, n) go to ``write``, a function of a frame and a batch number."""
    counts = stream.groupBy(key).agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def unexpired(rows: DataFrame, expires: str, now: str) -> DataFrame:
    """Stored rows whose lifetime is not over."""
    return rows.where(F.col(expires) > F.lit(now).cast("timestamp"))
