"""Hybrid retrieval for a batch of queries: buffer, graph (BM25 and cosine anchors, one hop, blend) and raw logs, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS, Settings
from mnemolake.durable import kept
from mnemolake.functions import dates, scoring, text
from mnemolake.operators import bm25, memory, vectors

RESULT = ["query", "node_id", "content", "score", "source", "ordinal"]


def eligible(as_of: Column | None, include_history: bool) -> Column:
    if as_of is not None:
        return dates.valid_at(F.coalesce("valid_from", "created_at"), F.col("valid_to"), as_of)
    return F.lit(True) if include_history else F.col("status") == "active"


def buffered(buffer: DataFrame, queries: DataFrame, as_of: Column | None = None, s: Settings = DEFAULTS, include_history: bool = False) -> DataFrame:
    """Entries that contain the whole query, newest first; without history, less those that a later hit of their session supersedes."""
    some = buffer.where(F.col("timestamp") <= as_of) if as_of is not None else buffer
    hit = some.join(F.broadcast(queries.select("query", "text")), F.contains(F.lower("content"), F.lower("text")))  # a batch of queries
    if not include_history:
        hit = hit.withColumns({"key": text.canonical_key(F.col("content")), "fix": text.is_correction(F.col("content"))})
        hit = hit.withColumns({"family": text.key_family(F.col("key")), "kind": F.array_position(F.array(*map(F.lit, text.PATTERNS)), F.col("type"))})
        again = F.lead(F.lit(True)).over(Window.partitionBy("query", "session_id", "key").orderBy("source_msg", "kind"))
        near = Window.partitionBy("query", "session_id", "family").orderBy("source_msg").rangeBetween(1, s.correction_window)
        fixed = F.col("family").isin(*text.IMPLICIT) & F.coalesce(F.max("fix").over(near), F.lit(False))
        hit = hit.withColumn("beaten", F.col("key").isNotNull() & (F.coalesce(again, F.lit(False)) | F.coalesce(fixed, F.lit(False)))).where("NOT beaten")
    return hit.select("query", F.lit("").alias("node_id"), "content", (2.0 + F.col("source_msg") * 1e-4).alias("score"), F.lit("buffer").alias("source"), (-F.col("source_msg")).cast("long").alias("ordinal"))


def graph(nodes: DataFrame, edges: DataFrame, queries: DataFrame, now: Column, as_of: Column | None = None, include_history: bool = False, s: Settings = DEFAULTS, semantic: bool = True, every: bool = False, p90: float | None = None) -> DataFrame:
    """(query, node_id, content, score, ..., trace) of each query's k best nodes, or of all that were ranked. queries: query, text, embedding. p90: of the access counts, where it is given; else it is theirs."""
    hits = bm25.search(nodes, queries, "id", "content", "query", "text", 5 * s.k, s)  # over all nodes; eligibility comes after
    # what several branches read is small, and written once: the hits of a question, its anchors, what they reach
    best = Window.partitionBy("query")
    lexical = kept(hits.select("query", F.col("doc").alias("node"), (F.col("score") / F.max("score").over(best)).alias("lexical")))
    reach = lexical.where(F.col("lexical") >= s.anchor_ratio).select("query", "node")
    if semantic:
        sims = vectors.similar(queries, nodes, "query", "id", "embedding", s.embed_threshold)
        reach = reach.union(sims.select("query", "node")).distinct()
    pool = nodes.where(eligible(as_of, include_history))
    anchors = kept(reach.join(pool.select(F.col("id").alias("node")), "node", "left_semi").select("query", "node"))
    reached = anchors.withColumn("association", F.lit(0.0))
    if s.neighbor_expansion:
        reached = reached.unionByName(memory.expanded(anchors, edges, s.neighbor_decay))
    reached = kept(reached)
    often = scoring.p90_of(nodes, "access_count") if p90 is None else nodes.sparkSession.createDataFrame([(p90,)], "p90 double")
    sim = scoring.cosine(F.col("q_embedding"), F.col("embedding")) if semantic else F.lit(0.0)
    bonus = F.when(F.lit(as_of is not None) | (F.col("status") == "active"), 1.0).otherwise(0.0)
    rows = (
        reached.join(pool, F.col("node") == F.col("id"))
        .join(queries.select("query", *([F.col("embedding").alias("q_embedding")] if semantic else [])), "query")
        .join(lexical, ["query", "node"], "left")
        .crossJoin(F.broadcast(often))  # one row
        .withColumns({"semantic": F.when(F.size("embedding") > 0, sim).otherwise(0.0), "lexical": F.coalesce("lexical", F.lit(0.0)), "strength_": scoring.strength(F.col("last_accessed"), F.col("access_count"), now, F.col("p90"), s), "conf": scoring.clamp(F.col("confidence")), "bonus": bonus})
    )
    scored = rows.withColumn("score", scoring.blended(F.col("semantic"), F.col("lexical"), F.col("strength_"), F.col("conf"), F.col("association"), F.col("bonus"), s))
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "node")
    ranked = scored.withColumn("ordinal", F.row_number().over(w).cast("long"))
    ranked = ranked if every else ranked.where(F.col("ordinal") <= s.k)
    return ranked.select("query", "status", F.col("node").alias("node_id"), "content", "score", F.lit("graph").alias("source"), "ordinal", F.struct("semantic", "lexical", F.col("strength_").alias("strength"), F.col("conf").alias("confidence"), "association", F.col("bonus").alias("status_bonus")).alias("trace"))


def raw_log(messages: DataFrame, queries: DataFrame, as_of: Column | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """BM25 over messages, the best scaled to raw_log_scale."""
    some = messages.where(F.col("timestamp") <= as_of) if as_of is not None else messages
    ids = some.withColumn("doc", F.concat_ws("/", "session_id", F.lpad(F.col("message_index").cast("string"), 9, "0")))
    hits = bm25.search(ids, queries, "doc", "content", "query", "text", s.k, s)
    w = Window.partitionBy("query")
    return hits.withColumn("score", F.col("score") / F.max("score").over(w) * s.raw_log_scale).join(ids.select("doc", "content"), "doc").select("query", F.lit("").alias("node_id"), "content", "score", F.lit("raw_log").alias("source"), F.col("rank").cast("long").alias("ordinal"))


def merged(parts: list[DataFrame], k: int, trace: bool = False) -> DataFrame:
    """Union, the best per 200-character prefix, the k best: by score, then source, then ordinal; with the features of graph results, if asked."""
    rank = F.coalesce(*[F.when(F.col("source") == n, i) for i, n in enumerate(("buffer", "graph", "raw_log"))])
    order = [F.round("score", 9).desc(), rank, "ordinal"]
    none = F.lit(None).cast("struct<semantic: double, lexical: double, strength: double, confidence: double, association: double, status_bonus: double>").alias("trace")
    part = lambda p: p.select(*RESULT, "trace" if trace and "trace" in p.columns else none)
    every = part(parts[0])
    for p in parts[1:]:
        every = every.unionByName(part(p))
    once = memory.first_by(every, ["query", F.substring("content", 1, 200)], order)
    w = Window.partitionBy("query").orderBy(*order)
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("ordinal")


def reinforced(nodes: DataFrame, access_log: DataFrame) -> DataFrame:
    """Fold an append-only log of (node_id, at) into the active nodes' counts and last access."""
    folded = access_log.groupBy(F.col("node_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"), F.max("at").alias("__at"))
    use = F.col("__n").isNotNull() & (F.col("status") == "active")
    joined = nodes.join(folded, F.col("id") == F.col("__id"), "left")
    return joined.withColumns({"access_count": F.when(use, F.col("access_count") + F.col("__n")).otherwise(F.col("access_count")), "last_accessed": F.when(use, F.greatest("last_accessed", "__at")).otherwise(F.col("last_accessed"))}).drop("__id", "__n", "__at")
