"""Streams of text chunks: decoding frames, joining chunks, keeping the latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DONE, ERROR, PREFIX = "[DONE]", "[ERROR]", "data: "


def decode_frames(frames: DataFrame, stream: str, seq: str, line: str) -> DataFrame:
    """(stream, seq, chunk): lines that begin with `data: `, up to the first `[DONE]` or
    `[ERROR]`. Lines without the prefix are lost, as where a chunk holds a newline."""
    body = frames.where(F.col(line).startswith(PREFIX)).withColumn("chunk", F.substring(line, len(PREFIX) + 1, 2147483647))
    stops = F.col("chunk").startswith(DONE) | F.col("chunk").startswith(ERROR)
    first = F.min(F.when(stops, F.col(seq))).over(Window.partitionBy(stream))
    return body.withColumn("_stop", first).where(F.col("_stop").isNull() | (F.col(seq) < F.col("_stop"))).select(stream, seq, "chunk")


def join_chunks(chunks: DataFrame, stream: str, seq: str, chunk: str) -> DataFrame:
    """(stream, message): chunks in order, nothing between."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(seq, chunk))), lambda x: x[chunk])
    return chunks.groupBy(stream).agg(F.array_join(parts, "").alias("message"))


def latest_state(updates: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key; works on batches and on streams (complete or update mode)."""
    cols = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_l")).select(key, "_l.*")


def level_at_least(level: Column, least: str) -> Column:
    """Log levels at or over one; unknown levels count as info."""
    rank = lambda c: F.when(c == "debug", 0).when(c == "warn", 2).when(c == "error", 3).otherwise(1)
    return rank(F.lower(level)) >= rank(F.lit(least))
