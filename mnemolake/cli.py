"""Command line: status, query, consolidate, snapshot, delete, eval, hook, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import IO

from pyspark.sql import SparkSession

from mnemolake import clients, hooks, replay, tools
from mnemolake.operators.vectors import mock_embedding
from mnemolake.session import Session
from mnemolake.shipping import ship
from mnemolake.sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mnemolake", description="Long-term memory of conversations")
    p.add_argument("--data-dir", default=os.path.expanduser("~/.mnemolake"))
    p.add_argument("--mock", action="store_true", help="deterministic vectors of the text's hash")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("status")
    q = c.add_parser("query")
    q.add_argument("query_text")
    q.add_argument("-k", type=int, default=10)
    q.add_argument("--include-history", action="store_true")
    q.add_argument("--trace", action="store_true")
    q.add_argument("--as-of")
    n = c.add_parser("consolidate")
    n.add_argument("--client-command", nargs="+", help="a program that answers transcripts; {system} and {user} stand for the texts")
    s = c.add_parser("snapshot")
    s.add_argument("action", choices=["create", "list", "restore"])
    s.add_argument("--path", help="the snapshot's name")
    c.add_parser("delete").add_argument("node_id")
    e = c.add_parser("eval")
    e.add_argument("-k", type=int, default=5)
    e.add_argument("--json", action="store_true")
    e.add_argument("--corpus")
    e.add_argument("--longmemeval", action="store_true")
    e.add_argument("--limit", type=int)
    c.add_parser("serve")
    c.add_parser("hook", add_help=False)
    return p


def evaluated(args: argparse.Namespace, spark: SparkSession, embed, out: IO[str]) -> None:  # noqa: ANN001
    if args.corpus:
        log, questions = store.longmemeval(spark, args.corpus, args.limit) if args.longmemeval else store.native_corpus(spark, args.corpus)
        report = replay.run(spark, args.data_dir, log, questions, args.k, embed=embed, name=os.path.splitext(os.path.basename(args.corpus))[0])
        print(json.dumps(report, indent=2) if args.json else replay.summary(report), file=out)
        return
    report = replay.benchmark(spark, args.data_dir, args.k, embed)
    if args.json:
        print(json.dumps(report, indent=2), file=out)
        return
    print(f"benchmark report\n  recall@{report['k']}: {report['recall_at_k']:.3f}\n  nDCG@{report['k']}: {report['ndcg_at_k']:.3f}\n  contradiction error rate: {report['contradiction_error_rate']:.3f}", file=out)
    print(f"  latency p50 (ms): {report['latency_ms']['p50']:.2f}\n  latency p95 (ms): {report['latency_ms']['p95']:.2f}\n  deletion audit passed: {report['deletion_audit']['passed']}", file=out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: IO[str] = sys.stdout, stdin: IO[str] = sys.stdin) -> int:
    args, rest = parser().parse_known_args(argv)
    if rest and args.command != "hook":
        parser().error(f"unknown arguments: {' '.join(rest)}")
    session = lambda: ship(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    embed = mock_embedding() if args.mock else None
    if args.command == "hook":
        return hooks.run(rest, lambda i: Session.start(session(), args.data_dir, i, embed=embed), stdin, out)
    if args.command == "eval":
        evaluated(args, session(), embed, out)
        return 0
    client = clients.Command(args.client_command) if getattr(args, "client_command", None) else None
    with Session.start(session(), args.data_dir, embed=embed, client=client) as s:
        if args.command == "status":
            print(json.dumps(s.status(), indent=2), file=out)
        elif args.command == "query":
            found = s.query(args.query_text, args.k, args.include_history, args.trace, args.as_of)
            for i, r in enumerate(found, 1):
                print(f"\n--- Result {i} (score: {r.score:.4f}, source: {r.source}) ---\n{r.content[:200]}", file=out)
                if args.trace and r.trace:
                    print("trace:", json.dumps(r.trace.asDict(), sort_keys=True), file=out)
            if not found:
                print("No results found.", file=out)
        elif args.command == "consolidate":
            print(tools.tools(lambda: s)["memory_consolidate"](), file=out)
        elif args.command == "snapshot":
            if args.action == "create":
                print(f"Snapshot created: {s.create_snapshot()}", file=out)
            elif args.action == "list":
                print("\n".join(s.snapshots()) or "No snapshots found.", file=out)
            elif not args.path:
                print("Error: --path required for restore", file=sys.stderr)
                return 1
            else:
                s.restore_snapshot(args.path)
                print(f"Restored from: {args.path}", file=out)
        elif args.command == "delete":
            print(tools.tools(lambda: s)["memory_delete_node"](args.node_id), file=out)
        else:
            tools.serve(lambda: s)
    return 0


if __name__ == "__main__":
    sys.exit(main())
