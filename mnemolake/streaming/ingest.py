"""Structured Streaming: extraction as messages arrive, and consolidation by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemolake import schema
from mnemolake.config import DEFAULTS, Settings
from mnemolake.operators import memory

BUFFERED_ROLES = ("user", "tool_result")


def message_stream(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema.MESSAGE).format(fmt).load(path)


def buffer_entries(messages: DataFrame) -> DataFrame:
    """Entries that the buffered roles' messages give; stateless, so batch and stream agree."""
    m = messages.where(F.col("role").isin(*BUFFERED_ROLES))
    from mnemolake.functions.text import matches

    return m.select("session_id", F.explode(matches(F.col("content"))).alias("e"), "timestamp", F.col("message_index").alias("source_msg")).select("session_id", "e.type", "e.content", "timestamp", "source_msg")


def start_buffer(messages: DataFrame, path: str, checkpoint: str, s: Settings = DEFAULTS, once: bool = False) -> StreamingQuery:
    """Append entries every flush interval (an empty interval writes nothing); the checkpoint resumes after a crash."""
    w = buffer_entries(messages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{s.flush_seconds} seconds")).start()


def start_consolidation(messages: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """`commit(batch, id)` is called with the new messages of each micro-batch; offsets are the progress table."""
    w = messages.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def dropped_twice(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same message fired twice counts once, within the watermark."""
    return messages.withWatermark("timestamp", delay).dropDuplicates(["session_id", "message_index", "timestamp"])


def extracted(messages: DataFrame) -> DataFrame:
    return memory.extracted(messages)
