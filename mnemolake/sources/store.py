"""Logs, versioned tables, snapshots, progress and corpora as Spark sources and sinks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake import schema
from mnemolake.functions.text import role_of

FORMATS = ("parquet", "json")


# --- message log ---


def append_messages(messages: DataFrame, path: str) -> None:
    """Append to a log partitioned by session; any session id is a safe directory name there."""
    messages.write.mode("append").partitionBy("session_id").json(path)


def read_messages(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    df = spark.read.schema(schema.MESSAGE).json(path)
    return df if session_id is None else df.where(F.col("session_id") == session_id)


def next_index(messages: DataFrame) -> DataFrame:
    """(session_id, next): where a session's numbering goes on; numbers are never given twice."""
    return messages.groupBy("session_id").agg((F.max("message_index") + 1).alias("next"))


def numbered(new: DataFrame, messages: DataFrame, order: list[str | Column]) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy(*order)
    start = next_index(messages)
    return new.join(start, "session_id", "left").withColumn("message_index", (F.coalesce("next", F.lit(0)) + F.row_number().over(w) - 1).cast("int")).drop("next")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, modified, messages), by modification time."""
    df = spark.read.schema(schema.MESSAGE).json(path)
    return df.groupBy("session_id").agg(F.max("_metadata.file_modification_time").alias("modified"), F.count(F.lit(1)).alias("messages")).orderBy("modified", "session_id")


# --- versioned tables: a snapshot is a directory, the newest complete one counts ---


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    done = [s.getPath() for s in fs.listStatus(p)]
    return sorted(d.getName() for d in done if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))


def write_version(df: DataFrame, path: str, name: str | None = None) -> str:
    """Write a new version; Spark's commit file makes it visible, so a lost job leaves nothing half-read."""
    name = name or f"v{time.time_ns():020d}"
    df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return name


def read_version(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    name = name or versions(spark, path)[-1]
    return spark.read.parquet(f"{path}/{name}")


def migrated(df: DataFrame) -> DataFrame:
    """Nodes of an older store with today's columns; what is missing gets its default."""
    from pyspark.sql.types import NullType

    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in schema.NODE.fields:
        c = F.col(f.name) if f.name in have and not isinstance(have[f.name], NullType) else F.lit(None)
        default = schema.NODE_DEFAULTS.get(f.name)
        c = c.cast(f.dataType)
        if f.dataType.typeName() == "array":
            c = F.coalesce(c, F.array().cast(f.dataType))
        cols.append((F.coalesce(c, F.lit(default).cast(f.dataType)) if default is not None else c).alias(f.name))
    return df.select(*cols).withColumn("valid_from", F.coalesce("valid_from", "created_at"))


def upserted(table: DataFrame, changed: DataFrame, removed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Unchanged rows and the changed ones; those named in `removed` go."""
    left = table.join(changed.select(key), key, "left_anti")
    if removed is not None:
        left = left.join(removed.select(key), key, "left_anti")
    return left.unionByName(changed, allowMissingColumns=True)


def store(kind: str) -> tuple[Callable, Callable]:
    """(read, write) of a storage format."""
    if kind not in FORMATS:
        raise ValueError(f"unknown storage format {kind!r}")
    return (lambda spark, path, s=None: (spark.read.schema(s) if s else spark.read).format(kind).load(path)), (lambda df, path: df.write.mode("overwrite").format(kind).save(path))


# --- progress ---


def pending(messages: DataFrame, progress: DataFrame) -> DataFrame:
    """Messages past their session's mark."""
    return messages.join(progress.select("session_id", "last_msg_index"), "session_id", "left").where(F.col("message_index") > F.coalesce("last_msg_index", F.lit(-1))).drop("last_msg_index")


def advanced(progress: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    new = done.groupBy("session_id").agg(F.max("message_index").cast("int").alias("last_msg_index")).withColumn("updated_at", now)
    return upserted(progress, new, key="session_id")


# --- corpora ---

_MESSAGES = "array<struct<role: string, content: string>>"


def native_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, questions) of one JSON document with sessions and questions."""
    doc = spark.read.schema(f"sessions array<struct<id: string, messages: {_MESSAGES}>>, questions array<struct<id: string, question: string, expected: array<string>, forbidden: array<string>, as_of: string, category: string>>").option("multiLine", True).json(path)
    s = doc.select(F.explode("sessions").alias("s")).select(F.col("s.id").alias("session_id"), F.posexplode("s.messages").alias("message_index", "m"))
    return s.select("session_id", "message_index", role_of(F.col("m.role")).alias("role"), "m.content"), doc.select(F.explode("questions").alias("q")).select("q.*")


def longmemeval(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same from an array of instances; session ids are put under their question's, answers may be one or many."""
    doc = spark.read.schema(f"question_id string, question_type string, question string, answer string, haystack_session_ids array<string>, haystack_sessions array<{_MESSAGES}>").option("multiLine", True).json(path)
    if limit is not None:
        doc = doc.limit(limit)
    s = doc.select("question_id", F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("z"))
    s = s.select(F.col("question_id").alias("group_id"), F.concat_ws("/", "question_id", "z.haystack_session_ids").alias("session_id"), F.posexplode("z.haystack_sessions").alias("message_index", "m"))
    answers = F.coalesce(F.from_json("answer", "array<string>"), F.array("answer"))
    return s.select("group_id", "session_id", "message_index", role_of(F.col("m.role")).alias("role"), "m.content"), doc.select(F.col("question_id").alias("id"), "question", answers.alias("expected"), F.col("question_type").alias("category"), F.col("question_id").alias("group_id"))
