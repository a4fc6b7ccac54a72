"""Proposals of a language model: transcripts in chunks, a client given by the caller, parsed and validated natively."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake import schema
from mnemolake.config import DEFAULTS, Settings
from mnemolake.functions.text import PATTERNS, canonical_key, normalized, statement_key
from mnemolake.operators.memory import first_by


def chunks(messages: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(session_id, chunk, first, last, transcript) of at most stage2_max_messages messages each."""
    w = Window.partitionBy("session_id").orderBy("message_index")
    numbered = messages.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / s.stage2_max_messages).cast("int"))
    line = F.struct("message_index", F.concat(F.lit("["), F.col("message_index").cast("string"), F.lit("] "), "role", F.lit(": "), "content").alias("line"))
    return numbered.groupBy("session_id", "chunk").agg(F.min("message_index").alias("first"), F.max("message_index").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("transcript"))


def asked(parts: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """Adds `reply`; a call that fails gives null and its chunk is passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(t: str) -> str | None:
            try:
                return client(t)
            except Exception:  # noqa: BLE001  the model's failure is not the job's
                return None

        for pdf in batches:
            yield pdf.assign(reply=pdf.transcript.map(one))

    return parts.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in parts.dtypes) + ", reply string")


def parsed(reply: Column) -> Column:
    """The memories of a reply: strict JSON, else the outermost braces, else none."""
    whole, inner = F.from_json(reply, schema.STAGE2)["memories"], F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), schema.STAGE2)["memories"]
    return F.coalesce(whole, inner)


def proposals(replies: DataFrame, known: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Valid proposals that are not known statements: enough confidence, sources within their chunk, readable dates."""
    rows = replies.select("session_id", "first", "last", F.explode(parsed(F.col("reply"))).alias("m")).select("session_id", "first", "last", "m.*")
    kept = rows.where((F.trim("content") != "") & (F.col("confidence") >= s.stage2_min_confidence)).withColumn("sources", F.filter("sources", lambda x: x.between(F.col("first"), F.col("last")))).where(F.size("sources") > 0)
    dated = kept.withColumns({"valid_from": F.col("valid_from").try_cast("timestamp"), "valid_to": F.col("valid_to").try_cast("timestamp"), "statement": statement_key(F.col("content"))})
    keys = [c for c in ("session_id", "statement") if c in known.columns]
    return dated.join(known.select(*keys).distinct(), keys, "left_anti").drop("first", "last")


def as_candidates(proposed: DataFrame) -> DataFrame:
    """Proposals as candidates like those of `memory.candidates`, the first of a statement in each session; a named slot is their key."""
    slot = F.when(F.trim("slot") != "", F.concat(F.lit("fact:"), normalized(F.col("slot"))))
    rows = proposed.select(
        "session_id", F.array_min("sources").cast("int").alias("message_index"), F.lit(len(PATTERNS) + 1).cast("long").alias("kind_order"), F.trim("content").alias("content"), "statement",
        F.coalesce(slot, canonical_key(F.col("content"))).alias("canonical_key"), F.coalesce("supersedes_previous", F.lit(False)).alias("is_correction"),
        F.when(F.col("type").isin("semantic", "procedural", "episodic"), F.col("type")).otherwise("semantic").alias("node_type"), F.least("confidence", F.lit(1.0)).alias("confidence"),
        F.col("valid_from").cast("date").alias("valid_from"), F.col("valid_to").cast("date").alias("valid_to"), F.array().cast("array<string>").alias("mentioned_dates"), F.array_sort(F.array_distinct("sources")).alias("sources"),
    )
    return first_by(rows, ["session_id", "statement"], ["message_index", "content"])
