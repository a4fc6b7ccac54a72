"""Stores of the single-process kind, read into tables and written back: one JSON graph, one SQLite graph, a JSONL log for each session, progress in its three schemas."""

from __future__ import annotations

import json
import sqlite3
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType, TimestampType

from mnemolake import schema
from mnemolake.sources import store

CHUNK = 20_000


def file_name(session_id: str) -> str:
    """A session's log file: any id is a safe name, and can be read back from it."""
    return quote(session_id, safe="") + ".jsonl"


def wal_name(session_id: str) -> str:
    """A session's write-ahead file: letters, digits, `-`, `_` and `.` stay, all else becomes `_`."""
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in session_id) + ".wal"


def _textual(kind: StructType) -> StructType:
    """The schema with instants as text, as JSON has them."""
    return StructType([StructField(f.name, StringType() if isinstance(f.dataType, TimestampType) else f.dataType) for f in kind.fields])


def _timed(df: DataFrame, kind: StructType) -> DataFrame:
    return df.select(*[F.col(f.name).try_cast("timestamp").alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name) for f in kind.fields])


def json_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON graph; what an older version lacks gets its default."""
    node, edge = _textual(schema.NODE), _textual(schema.EDGE)
    whole = StructType([StructField("nodes", MapType(StringType(), node)), StructField("edges", ArrayType(edge))])
    doc = spark.read.schema(whole).option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("key", "n")).select(F.coalesce("n.id", "key").alias("id"), *[F.col(f"n.{f.name}").alias(f.name) for f in node.fields if f.name != "id"])
    return store.migrated(_timed(nodes, schema.NODE)), _timed(doc.select(F.explode("edges").alias("e")).select("e.*"), schema.EDGE)


def write_json_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as one JSON document, written beside and renamed, so that a reader sees the old or the new one whole. For graphs that fit one file."""
    import os

    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write('{"version": "2.0", "nodes": {')
        for i, row in enumerate(nodes.select("id", F.to_json(F.struct(*nodes.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            f.write((", " if i else "") + json.dumps(row.id) + ": " + row.j)
        f.write('}, "edges": [')
        for i, row in enumerate(edges.select(F.to_json(F.struct(*edges.columns)).alias("j")).toLocalIterator()):
            f.write((", " if i else "") + row.j)
        f.write("]}")
    os.replace(path + ".tmp", path)


def sqlite_graph(spark: SparkSession, path: str, to: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a SQLite graph, copied chunk by chunk to tables under `to`; the driver holds one chunk."""

    @F.pandas_udf("array<float>")
    def floats(blob: pd.Series) -> pd.Series:
        return blob.map(lambda b: np.frombuffer(b, np.float32) if b else np.zeros(0, np.float32))

    node = _textual(schema.NODE)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute("SELECT id, data, embedding FROM nodes ORDER BY id")
        n = 0
        while True:
            chunk = [(i, d, None if b is None else bytearray(b)) for i, d, b in rows.fetchmany(CHUNK)]
            if n and not chunk:
                break
            raw = spark.createDataFrame(chunk, "key string, data string, blob binary")
            told = raw.select("key", "blob", F.from_json("data", node).alias("n"))
            full = told.select(F.col("key").alias("id"), *[(floats(F.col("blob")) if f.name == "embedding" else F.col(f"n.{f.name}")).alias(f.name) for f in node.fields if f.name != "id"])
            store.migrated(_timed(full, schema.NODE)).write.mode("append").parquet(f"{to}/nodes")
            n += 1
        edges = db.execute("SELECT source, target, type, weight, created_at FROM edges")
        n = 0
        while True:
            chunk = edges.fetchmany(CHUNK)
            if n and not chunk:
                break
            _timed(spark.createDataFrame(chunk, _textual(schema.EDGE)), schema.EDGE).write.mode("append").parquet(f"{to}/edges")
            n += 1
    return spark.read.parquet(f"{to}/nodes"), spark.read.parquet(f"{to}/edges")


def session_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of a folder of JSONL logs: the session is the unquoted file name, the index the line's number."""
    lines = spark.read.text(f"{folder}/*.jsonl", wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.jsonl$", "").alias("file"), "value")
    each = lines.select("file", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("message_index", "line"))
    told = each.select("file", "message_index", F.from_json("line", "timestamp string, role string, content string, metadata map<string,string>").alias("m"))
    # Spark quotes the path once more
    name = F.url_decode(F.url_decode("file"))
    return told.select(F.col("m.timestamp").try_cast("timestamp").alias("timestamp"), name.alias("session_id"), "message_index", F.col("m.role").alias("role"), F.col("m.content").alias("content"), F.col("m.metadata").alias("metadata"))


def progress(spark: SparkSession, path: str, messages: DataFrame) -> DataFrame:
    """Progress of any version: a list of sessions that were done in full, marks as plain numbers, or marks with their time."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f).get("sessions", {})
    now = F.current_timestamp()
    if isinstance(held, list):
        done = spark.createDataFrame([(str(x),) for x in held], "session_id string")
        last = messages.groupBy("session_id").agg(F.max("message_index").cast("int").alias("last_msg_index"))
        return done.join(last, "session_id", "left").select("session_id", F.coalesce("last_msg_index", F.lit(-1)).alias("last_msg_index"), now.alias("updated_at"))
    rows = [(k, int(v.get("last_msg_index", -1)), v.get("updated_at")) if isinstance(v, dict) else (k, int(v), None) for k, v in held.items()]
    df = spark.createDataFrame(rows, "session_id string, last_msg_index int, updated_at string")
    return df.withColumn("updated_at", F.coalesce(F.col("updated_at").try_cast("timestamp"), now))
