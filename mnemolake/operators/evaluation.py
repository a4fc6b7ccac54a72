"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.scoring import ndcg


def first_hits(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, category, rank, forbidden): where an expected string first occurs, and whether a forbidden one occurs at all."""
    said = F.lower("content")
    held = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.contains(said, F.lower(x)))
    joined = questions.join(results, questions.question == results.query, "left")
    return joined.groupBy("question", "category").agg(F.min(F.when(held(F.col("expected")), F.col("rank"))).alias("rank"), F.coalesce(F.bool_or(held(F.col("forbidden"))), F.lit(False)).alias("contradicted"))


def summary(hits: DataFrame, by: list[str]) -> DataFrame:
    """Recall, nDCG and contradiction rate; every question counts, asked or not."""
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), F.avg(F.col("rank").isNotNull().cast("int")).alias("recall"), F.avg(ndcg(F.col("rank"))).alias("ndcg"), F.avg(F.col("contradicted").cast("int")).alias("contradiction_rate"))


def latency(times: DataFrame, col: str) -> DataFrame:
    """Linear-interpolated p50 and p95."""
    return times.agg(F.percentile(col, 0.5).alias("p50"), F.percentile(col, 0.95).alias("p95"))
