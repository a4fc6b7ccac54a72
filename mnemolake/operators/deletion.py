"""Hard deletion as anti-joins over nodes, edges, messages, buffer and snapshots, with hashed tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.text import folded


def nodes_without(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes less the deleted; `supersedes` lists lose their ids."""
    left = nodes.join(gone.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti")
    refs = left.select("id", F.explode("supersedes").alias("old")).join(gone.select(F.col("id").alias("old")), "old", "left_anti").groupBy(F.col("id").alias("__id")).agg(F.array_sort(F.collect_list("old")).alias("__left"))
    return left.join(refs, F.col("id") == F.col("__id"), "left").withColumn("supersedes", F.coalesce("__left", F.array().cast("array<string>"))).drop("__id", "__left")


def edges_without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    ids = gone.select(F.col("id").alias("__id"))
    return edges.join(ids, F.col("source") == F.col("__id"), "left_anti").join(ids, F.col("target") == F.col("__id"), "left_anti")


def references(refs: Column) -> Column:
    """References that name a session and a message, each once."""
    return F.array_distinct(F.filter(F.coalesce(refs, F.array().cast("array<struct<session_id: string, message_index: int>>")), lambda r: r["session_id"].isNotNull() & r["message_index"].isNotNull()))


def messages_of(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """(session_id, message_index) of what deleted nodes were made from: by reference, or by exact content in their sessions where a node has none."""
    own = gone.withColumn("refs", references(F.col("source_refs")))
    told = own.select(F.explode("refs").alias("r")).select("r.session_id", "r.message_index")
    alike = own.where("size(refs) = 0").select(F.explode("source_sessions").alias("session_id"), folded(F.col("content")).alias("key")).distinct()
    said = messages.select("session_id", "message_index", folded(F.col("content")).alias("key")).join(alike, ["session_id", "key"], "left_semi")
    return told.join(messages.select("session_id", "message_index"), ["session_id", "message_index"], "left_semi").unionByName(said.select("session_id", "message_index")).distinct()


def strategy(source_refs: Column) -> Column:
    """How a node's messages are found."""
    return F.when(F.size(references(source_refs)) > 0, "source_refs").otherwise("exact_content")


def messages_without(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Messages less those that deleted nodes refer to, by an index that is never renumbered."""
    refs = gone.select(F.explode("source_refs").alias("r")).select(F.col("r.session_id").alias("session_id"), F.col("r.message_index").alias("message_index"))
    return messages.join(refs, ["session_id", "message_index"], "left_anti")


def rows_without(rows: DataFrame, contents: DataFrame, col: str = "content") -> DataFrame:
    """Rows less those whose folded content equals a deleted one's exactly."""
    keys = contents.select(folded(F.col("content")).alias("__key")).distinct()
    return rows.withColumn("__own", folded(F.col(col))).join(keys, F.col("__own") == F.col("__key"), "left_anti").drop("__own")


def tombstones(gone: DataFrame, edges: DataFrame, at: Column) -> DataFrame:
    """An audit row for each node; content only as a hash. Each incident edge counts once, a self-loop too."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return gone.join(ends, "id", "left").select(F.sha2(F.concat_ws("|", "id", at.cast("string")), 256).alias("tombstone_id"), at.alias("timestamp"), F.col("id").alias("node_id"), F.sha2(folded(F.col("content")), 256).alias("content_hash"), F.col("source_sessions").alias("affected_sessions"), F.coalesce("n", F.lit(0)).alias("edges_removed"))
