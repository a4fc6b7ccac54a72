"""Replay of a corpus, and the built-in benchmark with its deletion audit."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake import schema
from mnemolake.api import Memory
from mnemolake.config import DEFAULTS, Settings
from mnemolake.operators import evaluation
from mnemolake.session import Session
from mnemolake.sources import store

#: The benchmark's statements, what corrects them, and its questions with what is wanted and what is not; fixed values.
SAID = ["My preferred language is Python", "The API endpoint is https://api.v1.example.com", "My city is San Francisco"]
CORRECTED = ["Actually, my preferred language is Rust", "Actually, the API endpoint is https://api.v2.example.com", "Actually, my city is New York"]
CASES = [("preferred_language", "What is my preferred language?", "rust", "python"), ("api_endpoint", "What is the API endpoint?", "v2", "v1"), ("city", "What is my city?", "new york", "san francisco")]
SECRET = "alpha-123-secret"


def _percentiles(ms: list[float]) -> dict[str, float]:
    return {f"p{p}": float(np.percentile(ms, p)) if ms else 0.0 for p in (50, 95)}


def _asked(memory: Memory, questions: list, k: int, buffer: DataFrame) -> tuple[list[dict], list[float]]:
    """A case for each question, asked at its own moment. questions: rows with id, question, expected, forbidden, as_of, category."""
    cases, took = [], []
    for q in questions:
        began = time.perf_counter()
        moment = memory.spark.sql("SELECT try_cast(:t AS timestamp)", {"t": q.as_of}).first()[0] if q.as_of else None
        found = [r.content for r in memory.query([q.question], moment, buffer=buffer, k=k).orderBy("rank").collect()]
        took.append((time.perf_counter() - began) * 1000)
        rank = next((i for i, c in enumerate(found, 1) if any(x.lower() in c.lower() for x in q.expected or [])), None)
        bad = any(x.lower() in c.lower() for c in found for x in q.forbidden or [])
        cases.append({"id": q.id, "question": q.question, "category": q.category, "hit_rank": rank, "forbidden_hit": bad, "latency_ms": took[-1], "top_results": found[:3]})
    return cases, took


def scored(spark: SparkSession, cases: list[dict]) -> tuple[dict, dict]:
    """(totals, by category) of the cases, by the operators' metrics."""
    rows = [(c["id"], c["category"] or "all", c["hit_rank"], c["forbidden_hit"]) for c in cases]
    hits = spark.createDataFrame(rows, "question string, category string, rank int, contradicted boolean")
    whole = evaluation.summary(hits.withColumn("category", F.lit("all")), ["category"]).first()
    totals = {"recall_at_k": whole.recall, "ndcg_at_k": whole.ndcg, "contradiction_error_rate": whole.contradiction_rate} if whole else {"recall_at_k": 0.0, "ndcg_at_k": 0.0, "contradiction_error_rate": 0.0}
    return totals, {r.category: {"questions": r.questions, "recall_at_k": r.recall} for r in evaluation.summary(hits, ["category"]).orderBy("category").collect()}


def group_of(session_id: Column, scope: bool = True) -> Column:
    """The instance that a session belongs to: what stands before its first slash, or none."""
    return F.when(session_id.contains("/"), F.substring_index(session_id, "/", 1)).otherwise("") if scope else F.lit("")


def scoped(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """Questions with the group that they are asked of: the one that bears their id, else the shared one. groups: group."""
    own = groups.select(F.col("group").alias("id")).distinct().withColumn("own", F.lit(True))
    return questions.join(own, "id", "left").withColumn("group", F.when(F.col("own"), F.col("id")).otherwise("")).drop("own")


def run(spark: SparkSession, root: str, messages: DataFrame, questions: DataFrame, k: int = 5, settings: Settings = DEFAULTS, embed: Callable[[Column], Column] | None = None, extract=None, client=None, session_scope: bool = True, name: str = "corpus") -> dict:  # noqa: ANN001
    """Replay a corpus and score every question. messages and questions as `store.native_corpus` and `store.longmemeval` give them.

    With session_scope, sessions named `instance/...` go to a store of their instance, consolidated in one batch,
    and a question is asked of the store that bears its id, else of the shared one. Stores are made one after the
    other under `root`; a store's sessions are folded in one job, however many they are.
    """
    settings = replace(settings, cold_start_sessions=0, k=k)
    log = messages.withColumn("group", group_of(F.col("session_id"), session_scope))
    groups = sorted(r.group for r in log.select("group").distinct().collect())
    wide = questions
    for c, t in (("forbidden", "array<string>"), ("as_of", "string"), ("category", "string")):
        wide = wide if c in wide.columns else wide.withColumn(c, F.lit(None).cast(t))
    by: dict[str, list] = {}
    for q in scoped(wide, log).collect():
        by.setdefault(q.group, []).append(q)
    cases, took, nodes, spent = [], [], 0, 0.0
    none = spark.createDataFrame([], schema.BUFFER_ENTRY)
    for i, group in enumerate(groups):
        began = time.perf_counter()
        memory = Memory(spark, f"{root}/replay_{uuid.uuid4().hex}_{i}", settings, embed, extract, client)
        own = log.where(F.col("group") == group).select(F.current_timestamp().alias("timestamp"), "session_id", F.col("message_index").cast("int").alias("message_index"), "role", "content", F.lit(None).cast("map<string,string>").alias("metadata"))
        store.append_messages(own, f"{memory.root}/messages")
        nodes += sum(memory.consolidate_counts().values())
        spent += time.perf_counter() - began
        more, ms = _asked(memory, by.pop(group, []), k, none)
        cases += more
        took += ms
    cases += [{"id": q.id, "question": q.question, "category": q.category, "hit_rank": None, "forbidden_hit": False, "latency_ms": 0.0, "top_results": []} for left in by.values() for q in left]
    totals, parts = scored(spark, cases)
    n = messages.agg(F.count_distinct("session_id"), F.count(F.lit(1))).first()
    return {"corpus": name, "sessions": n[0], "messages": n[1], "questions": len(cases), "k": k, "nodes": nodes, "ingest_seconds": spent, **totals, "latency_ms": _percentiles(took), "by_category": parts, "cases": cases}


def benchmark(spark: SparkSession, root: str, k: int = 5, embed: Callable[[Column], Column] | None = None) -> dict:
    """Statements and their corrections in two sessions, three questions, and whether a deleted secret is gone everywhere."""
    settings = replace(DEFAULTS, cold_start_sessions=0, k=max(k, 1))
    root = f"{root}/benchmark_{uuid.uuid4().hex}"
    for session_id, said in (("baseline", SAID), ("corrections", CORRECTED)):
        with Session.start(spark, root, session_id, settings, embed) as s:
            for x in said:
                s.log("user", x)
            s.consolidate_current()
    asked = spark.createDataFrame([(n, q, [want], [bad], None, n) for n, q, want, bad in CASES], "id string, question string, expected array<string>, forbidden array<string>, as_of string, category string").collect()
    cases, took = _asked(Memory(spark, root, settings, embed), asked, settings.k, spark.createDataFrame([], schema.BUFFER_ENTRY))
    return {"version": "builtin-v1", "query_count": len(cases), "k": settings.k, **scored(spark, cases)[0], "latency_ms": _percentiles(took), "cases": cases, "deletion_audit": audit(spark, root, settings, embed)}


def audit(spark: SparkSession, root: str, settings: Settings = DEFAULTS, embed: Callable[[Column], Column] | None = None) -> dict:
    """Log, consolidate and snapshot a secret, delete its node, and look for it in logs, snapshots and answers."""
    with Session.start(spark, root, "privacy", settings, embed) as s:
        s.log("user", f"My token is {SECRET}")
        s.consolidate_current()
        s.create_snapshot()
        holds = F.lower("content").contains(SECRET)
        node = s.memory.nodes().where(holds).first()
        if node is None:
            return {"passed": False, "reason": "secret_node_not_found"}
        done = s.delete_node(node.id)
        left = {
            "logs_clean": s.memory.messages().where(holds).isEmpty(),
            "snapshots_clean": all(store.read_version(spark, f"{s.memory.root}/{part}", v).where(holds).isEmpty() for part in ("snapshots", "snapshot_buffers") for v in store.versions(spark, f"{s.memory.root}/{part}")),
            "query_clean": not any(SECRET in r.content.lower() for r in s.query(SECRET, include_history=True)),
        }
    return {"passed": all(left.values()), **left, "deletion_result": {x: getattr(done, x) for x in ("node_deleted", "snapshots_touched", "tombstone_id", "ledger_record_id")}}


def summary(report: dict) -> str:
    lines = [
        f"replay: {report['corpus']}", f"  sessions {report['sessions']}, messages {report['messages']}, nodes {report['nodes']}, ingest {report['ingest_seconds']:.1f}s",
        f"  recall@{report['k']}: {report['recall_at_k']:.3f}", f"  nDCG@{report['k']}: {report['ndcg_at_k']:.3f}", f"  contradiction error rate: {report['contradiction_error_rate']:.3f}",
        f"  latency p50/p95 (ms): {report['latency_ms']['p50']:.1f} / {report['latency_ms']['p95']:.1f}",
    ]
    return "\n".join(lines + [f"    {name}: recall {v['recall_at_k']:.3f} over {v['questions']}" for name, v in report["by_category"].items() if name != "all"])
