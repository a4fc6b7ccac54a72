"""A training-data pipeline over `documents`: quality rules, line dedup, near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written and read back before the
next. All but the last return the columns of documents; the last returns a row for each
packed piece. Columns that documents has beyond the known ones pass through.

Nulls: a null text fails the quality rules. A row without doc_id is deduplicated with nothing, by line
or text, and packed as any. Empty texts that line dedup leaves are packed without a bin. Repeated rows
are cut alike, and stay or go together in near_dedup. Ties: of equals the least doc_id stays in near_dedup, the largest keeps
its line in line_dedup. Very long texts are read whole and cut only by packing. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import lines, minhash, packing, pii, quality
from mnemolake.llm.base import checkpointed, documents
from mnemolake.shipping import ship


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where documents has it, follows the text."""
    return docs.select(*[(F.length("text").cast(t) if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c, t in docs.dtypes])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _measured(lines.deduplicated(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.deduplicated(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _measured(pii.redacted_documents(docs))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii", redaction),
    ("packing", packs),
]

#: Components and best-fit order cannot be said in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
