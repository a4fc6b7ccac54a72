"""Similarity joins over embeddings.

A query matrix of at most BLOCK rows is compared with all vectors at a time by one matrix product
for each Arrow batch; more queries are taken block by block, so nothing that grows with the data is
ever broadcast and no cross join is planned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def similar(queries: DataFrame, vectors: DataFrame, qid: str, vid: str, vec: str, least: float, block: int = BLOCK) -> DataFrame:
    """(query, node, sim) with cosine >= least; vectors that are empty or null take no part."""
    held = queries.where(F.size(vec) > 0).select(F.col(qid).alias("q"), F.col(vec).alias("v"))
    numbered = held.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-held.count() // block)))))
    blocks = [r.block for r in numbered.select("block").distinct().collect()]
    out = None
    for b in blocks:
        rows = numbered.where(F.col("block") == b).toPandas()  # about BLOCK rows
        ids, matrix = rows.q.to_numpy(), units(np.array(rows.v.tolist(), np.float64))

        def run(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                sims = units(np.array(pdf.v.tolist(), np.float64)) @ matrix.T if len(pdf) else np.zeros((0, len(ids)))
                i, j = np.nonzero(sims >= least)
                yield pd.DataFrame({"query": ids[j], "node": pdf.n.to_numpy()[i], "sim": sims[i, j]})

        types = dict(queries.dtypes), dict(vectors.dtypes)
        part = vectors.where(F.size(vec) > 0).select(F.col(vid).alias("n"), F.col(vec).alias("v")).mapInPandas(run, f"query {types[0][qid]}, node {types[1][vid]}, sim double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"query {dict(queries.dtypes)[qid]}, node {dict(vectors.dtypes)[vid]}, sim double")
    return out


def nearest(pairs: DataFrame) -> DataFrame:
    """For each query its most similar node; of equally similar ones the least."""
    return pairs.groupBy("query").agg(F.min(F.struct((-F.col("sim")).alias("far"), "node")).alias("b")).select("query", "b.node", (-F.col("b.far")).alias("sim"))


def mock_embedding(dim: int = 384) -> Column:
    """A factory of deterministic unit vectors seeded by the text's SHA-256."""

    @F.pandas_udf("array<float>")
    def encode(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            seed = int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:4], "big")
            v = np.random.RandomState(seed).randn(dim).astype(np.float32)
            return v / max(np.linalg.norm(v), 1e-8)

        return text.map(one)

    return encode
