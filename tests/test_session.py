"""The session surface: lifecycle, buffer, entities, deletion, replay, hooks, tools, command line, older stores."""

import io
import json
import sqlite3
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake import clients, hooks, replay, schema, tools
from mnemolake.api import Memory
from mnemolake.cli import main
from mnemolake.config import DEFAULTS
from mnemolake.operators import consolidate, deletion, entities, memory, retrieval
from mnemolake.operators.vectors import mock_embedding
from mnemolake.session import Session
from mnemolake.sources import legacy, store

UTC = timezone.utc
T0 = datetime(2026, 1, 1, tzinfo=UTC)


def log(spark, rows):
    """Messages (session, role, content), one second apart."""
    seen = {}
    out = []
    for i, (s, r, c) in enumerate(rows):
        seen[s] = seen.get(s, -1) + 1
        out.append((T0 + timedelta(seconds=i), s, seen[s], r, c, None))
    return spark.createDataFrame(out, schema.MESSAGE)


def none(spark):
    return spark.createDataFrame([], schema.NODE)


def at(day=2):
    return F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp")


def test_buffer_supersedes_within_its_session_only(spark):
    rows = [("a", "user", "I prefer tea"), ("b", "user", "Actually, I prefer tea"), ("c", "user", "My port is 80"), ("c", "user", "My port is 81"), ("c", "user", "I prefer rust tea"), ("c", "user", "Actually, I prefer python tea")]
    from mnemolake.streaming import ingest

    entries = ingest.buffer_entries(log(spark, rows))
    q = spark.createDataFrame([(0, "tea"), (1, "port")], "query int, text string")
    got = lambda history: sorted((r.query, r.content) for r in retrieval.buffered(entries, q, include_history=history).collect())
    # c's correction beats the preference before it; a and b stand apart, c's port is told anew
    assert (0, "I prefer tea") in got(False) and (1, "My port is 80") not in got(False) and (1, "My port is 81") in got(False)
    assert (0, "I prefer rust tea") not in got(False) and {(0, "I prefer rust tea"), (1, "My port is 80")} <= set(got(True))


def test_patterns_and_white_space_are_unicode(spark):
    from mnemolake.functions import text

    said = ["my größe is 5", "our señal año is ok", "I prefer tea", "größe: xactually, no", "I use Rust", "ACTUALLY, yes"]
    got = [[(m.type, m.content) for m in r.m] for r in spark.createDataFrame(list(enumerate(said)), "i int, c string").select("i", text.matches(F.col("c")).alias("m")).orderBy("i").collect()]
    assert got[0] == [("fact", "my größe is 5")] and got[1] == [("fact", "our señal año is ok")] and got[2] == [("preference", "I prefer tea")]
    assert got[3] == [] and got[5] == [("correction", "ACTUALLY, yes")]
    one = spark.createDataFrame([("  My Größe 　",)], "c string").select(text.normalized(F.col("c")).alias("n"), text.folded(F.col("c")).alias("f")).first()
    assert (one.n, one.f) == ("my größe", "my größe")


def test_a_date_inside_a_number_is_not_its_place(spark):
    from mnemolake.functions import dates

    said = "ref 112/5/2024 then from 12/5/2024"
    d = spark.createDataFrame([(said,)], "c string").select(dates.mentions(F.col("c"), at()).alias("d"), "c").select("d", dates.validity(F.col("c"), F.col("d")).alias("w")).first()
    assert [x.start for x in d.d if x.original == "12/5/2024"] == [said.rindex("12/5/2024") + 1] and str(d.w.valid_from) == "2024-12-05"


def test_entities_are_found_resolved_and_mentioned(spark):
    extract = entities.gazetteer({"Acme": "ORG", "Acme Holdings": "ORG", "Alice": "PERSON", "three": "CARDINAL", "Globex Research": "ORG", "Globex": "ORG"})
    rows = [("s", "user", "Acme called"), ("s", "user", "The Acme Holdings contract is signed by three"), ("s", "user", "My boss is Alice"), ("t", "user", "My client is Globex"), ("t", "user", "Globex Research answered")]
    after, edges = consolidate.batch(log(spark, rows), none(spark), at(), extract=extract)
    by = {r.content: r for r in after.collect()}
    assert {c for c in by if by[c].entity_type} == {"ORG: Acme", "PERSON: Alice", "ORG: Globex"}
    assert by["ORG: Acme"].aliases == ["Acme Holdings"] and by["ORG: Globex"].aliases == ["Globex Research"] and by["ORG: Acme"].confidence == 0.75
    links = {(e.source, e.target, e.type, e.weight) for e in edges.collect()}
    name = {r.id: c for c, r in by.items()}
    assert {(name[a], name[b], w) for a, b, t, w in links if t == "association"} == {("The Acme Holdings contract is signed by three", "ORG: Acme", 0.8), ("My boss is Alice", "PERSON: Alice", 0.8), ("My client is Globex", "ORG: Globex", 0.8)}
    # later, another spelling is the same node, of the same label only
    later = log(spark, [("u", "user", "Acme Ltd is late"), ("u", "user", "Alice is here")])
    more = entities.gazetteer({"Acme Ltd": "ORG", "Alice": "ORG"})
    again, edges = consolidate.batch(later, after, at(3), extract=more)
    found = {r.content: r for r in again.where("entity_type IS NOT NULL").collect()}
    assert set(found) == {"ORG: Acme", "PERSON: Alice", "ORG: Globex", "ORG: Alice"}
    assert "Acme Ltd" in found["ORG: Acme"].aliases and found["ORG: Acme"].source_sessions == ["s", "u"] and found["ORG: Acme"].access_count == 2


def test_resolution_needs_the_first_word_one_candidate_and_the_label(spark):
    rows = [("1", "ORG: Acme Holdings", None, []), ("2", "Globex Research Lab", "ORG", ["globex.io"]), ("3", "Globex Foods", "ORG", []), ("4", "a statement", None, [])]
    nodes = spark.createDataFrame(rows, "id string, content string, entity_type string, aliases array<string>")
    asked = [("Acme", "ORG"), ("Acme", "PERSON"), ("Acme", None), ("Research Lab", "ORG"), ("Globex Research", "ORG"), ("Globex", "ORG"), ("globex.io", "ORG"), ("Nobody", None)]
    got = {(r.name, r.label): r.entity for r in entities.resolved(spark.createDataFrame(asked, "name string, label string"), nodes).collect()}
    assert got == {("Acme", "ORG"): "1", ("Acme", None): "1", ("Globex Research", "ORG"): "2", ("Globex", "ORG"): "2", ("globex.io", "ORG"): "2"}


def test_sessions_fold_in_order_and_twice_is_once(spark):
    rows = [("a", "user", "My port is 80"), ("b", "user", "My port is 81"), ("c", "user", "My port is 80"), ("c", "user", "it worked"), ("c", "user", "error: disk full")]
    messages = log(spark, rows)
    after, edges = consolidate.batch(messages, none(spark), at())
    by = {r.content: r for r in after.collect()}
    assert by["My port is 80"].source_sessions == ["a", "c"] and by["My port is 80"].access_count == 2 and by["My port is 80"].status == "superseded" and by["My port is 81"].status == "active"
    assert {(e.source, e.target) for e in edges.collect()} == {(by["it worked"].id, by["error: disk full"].id)}
    assert all(r.strength.frequency == r.access_count and 0 < r.strength.composite <= 1 for r in by.values())
    again, more = consolidate.batch(messages, after, at(), mock_embedding(8))
    assert {r.id: (r.access_count, r.source_sessions, r.status) for r in again.collect()} == {r.id: (r.access_count, r.source_sessions, r.status) for r in by.values()} and more.count() == 0


def test_a_correction_looks_at_the_latest_reference_in_its_session(spark):
    after, _ = consolidate.batch(log(spark, [("s", "user", "I prefer python for work"), *[("s", "user", "hm")] * 5]), none(spark), at())
    node = after.first()
    near = after.withColumn("source_refs", F.array(*[F.struct(F.lit(s).alias("session_id"), F.lit(i).alias("message_index")) for s, i in (("s", 0), ("s", 5), ("other", 90))]))
    fix = spark.createDataFrame([(T0, "s", 7, "user", "Actually, I prefer rust", None)], schema.MESSAGE)
    status = lambda nodes: {r.id: r.status for r in consolidate.batch(fix, nodes, at(3))[0].collect()}[node.id]
    assert status(near) == "superseded" and status(after) == "active"


def test_stage_two_becomes_nodes(spark):
    reply = json.dumps({"memories": [{"content": "The user owns a cat", "type": "odd", "slot": "pet", "confidence": 1.7, "sources": [1, 0, 1], "valid_from": "2025-05-01", "supersedes_previous": True}, {"content": "My port is 80", "confidence": 0.9, "sources": [0]}, {"content": "no source", "confidence": 0.9, "sources": [9]}]})
    asked = clients.make("canned", [reply])
    after, _ = consolidate.batch(log(spark, [("s", "user", "My port is 80"), ("s", "user", "the cat sleeps")]).coalesce(1), none(spark), at(), client=asked)
    by = {r.content: r for r in after.collect()}
    cat = by["The user owns a cat"]
    assert set(by) == {"My port is 80", "The user owns a cat"} and cat.canonical_key == "fact:pet" and cat.type == "semantic" and cat.confidence == 1.0 and str(cat.valid_from)[:10] == "2025-05-01"
    assert [r.message_index for r in cat.source_refs] == [0, 1]


def test_clients(tmp_path):
    class Done:
        returncode, stdout, stderr = 0, json.dumps({"structured_output": {"memories": []}}), ""

    seen = {}

    def runner(args, **how):
        seen.update(args=args, env=how["env"])
        return Done

    c = clients.Command(["tool", "-s", "{system}", "{user}"], runner=runner)
    assert c("hello") == '{"memories": []}' and seen["args"][-1] == "hello" and seen["env"][clients.GUARD] == "1"
    Done.stdout = json.dumps({"result": "text"})
    assert c("x") == "text"
    Done.stdout = "plain"
    assert c("x") == "plain"
    Done.returncode = 1
    with pytest.raises(RuntimeError):
        c("x")
    with pytest.raises(RuntimeError):
        clients.Service(lambda system, user: None)("x")
    with pytest.raises(ValueError, match="unknown"):
        clients.make("other", None)


def test_session_buffer_is_recovered_and_cleared(spark, tmp_path):
    root = str(tmp_path / "m")
    s = Session.start(spark, root, "s/1 ä")
    s.log("user", "I prefer tea", at=T0)
    s.log("assistant", "I prefer nothing", at=T0)
    assert [e.type for e in s.entries] == ["preference"] and s.by_type("fact") == [] and s.flush() and not s.flush()
    s.suspend()
    again = Session.start(spark, root, "s/1 ä")
    assert [(e.type, e.content) for e in again.entries] == [("preference", "I prefer tea")]
    found = again.query("prefer tea", now=T0)
    assert found[0].source == "buffer" and again.status() | {} == {"session_id": "s/1 ä", "node_count": 0, "edge_count": 0, "buffer_entries": 1, "total_sessions": 1, "log_messages": 2}
    again.end()
    assert Session.start(spark, root, "s/1 ä").entries == []
    assert again.memory.delete_session("s/1 ä") == 2 and again.memory.messages().count() == 0 and again.memory.delete_session("s/1 ä") == 0


def test_query_reinforces_what_it_ranked(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.log([("s", "user", "My editor is vim"), ("s", "user", "My city is Rome")], T0)
    assert m.consolidate_counts(T0) == {"s": 2} and m.consolidate_counts(T0) == {}
    m.query(["editor"], now=T0 + timedelta(days=1))
    counts = lambda: {r.content: r.access_count for r in m.nodes().collect()}
    assert counts() == {"My editor is vim": 2, "My city is Rome": 1}
    m.log([("s", "user", "hm")], T0)
    m.consolidate(T0)
    assert counts() == {"My editor is vim": 2, "My city is Rome": 1}


def test_deletion_in_full(spark, tmp_path):
    s = Session.start(spark, str(tmp_path / "m"), "s")
    for x in ("My token is alpha", "My city is Rome", "my TOKEN  is alpha"):
        s.log("user", x, at=T0)
    s.consolidate_current(T0)
    s.create_snapshot()
    nodes = s.memory.nodes()
    # a node without references is found in its sessions by exact content
    s.memory._save("nodes", nodes.withColumn("source_refs", F.when(F.lower("content").contains("token"), F.array().cast(nodes.schema["source_refs"].dataType)).otherwise(F.col("source_refs"))))
    node = s.memory.nodes().where("lower(content) LIKE '%token%'").first()
    r = s.delete_node(node.id)
    assert (r.node_deleted, r.match_strategy, r.log_entries_removed, r.exact_matches_removed, r.affected_sessions, r.snapshots_touched, r.buffer_entries_removed) == (True, "exact_content", 2, 2, ["s"], 1, 2)
    assert s.memory.ledger().where(F.col("record_id") == r.ledger_record_id).count() == 1 and r.tombstone_id
    assert [x.content for x in s.memory.messages().collect()] == ["My city is Rome"] and not s.delete_node("nobody").node_deleted
    s.restore_snapshot()
    assert [x.content for x in s.memory.nodes().collect()] == ["My city is Rome"] and [e.content for e in s.entries] == ["My city is Rome"] and len(s.snapshots()) == 1
    refs = spark.createDataFrame([([("s", 1), ("s", 1), (None, 2), ("s", None)],)], "r array<struct<session_id: string, message_index: int>>").select(deletion.references(F.col("r")).alias("r")).first().r
    assert [tuple(x) for x in refs] == [("s", 1)]


def test_benchmark_and_audit(spark, tmp_path):
    report = replay.benchmark(spark, str(tmp_path), 5)
    assert report["recall_at_k"] == 1.0 and report["contradiction_error_rate"] == 0.0 and report["query_count"] == 3 and report["deletion_audit"]["passed"]


def test_replay_scopes_questions_to_their_instance(spark, tmp_path):
    data = [{"question_id": q, "question_type": "t", "question": "What is my city?", "answer": city, "haystack_session_ids": ["x"], "haystack_sessions": [[{"role": "user", "content": f"My city is {city}"}]]} for q, city in (("q1", "Rome"), ("q2", "Oslo"))]
    (tmp_path / "l.json").write_text(json.dumps(data))
    messages, questions = store.longmemeval(spark, str(tmp_path / "l.json"))
    scoped = replay.run(spark, str(tmp_path / "a"), messages, questions, 1)
    assert (scoped["recall_at_k"], scoped["sessions"], scoped["messages"], scoped["nodes"], scoped["questions"]) == (1.0, 2, 2, 2, 2) and "recall" in replay.summary(scoped)
    shared = replay.run(spark, str(tmp_path / "b"), messages, questions, 1, session_scope=False)
    assert shared["recall_at_k"] == 0.5 and shared["by_category"] == {"t": {"questions": 2, "recall_at_k": 0.5}}


def test_hooks(spark, tmp_path, monkeypatch):
    start = lambda i: Session.start(spark, str(tmp_path / "m"), i)

    def fire(event, payload, *more):
        out, err = io.StringIO(), io.StringIO()
        assert hooks.run([event, *more], start, io.StringIO(payload if isinstance(payload, str) else json.dumps(payload)), out, err) == 0
        return out.getvalue(), err.getvalue()

    assert fire("prompt", {"session_id": "1", "prompt": "My editor is vim"})[0].startswith('{"hookSpecificOutput"')
    fire("stop", {"session_id": "1", "last_assistant_message": "noted"})
    fire("stop", {"session_id": "host-1", "last_assistant_message": "noted"})
    log_ = start("host-1").memory.messages().collect()
    assert sorted((r.role, r.content) for r in log_) == [("assistant", "noted"), ("user", "My editor is vim")]
    assert "consolidated 1 new memory" in fire("session-end", {"session_id": "1"})[1]
    said = json.loads(fire("prompt", {"session_id": "2", "user_prompt": "Which editor?"}, "-k", "2")[0])["hookSpecificOutput"]["additionalContext"].split("\n")
    # while there are few sessions the raw log answers too, the prompt itself among it
    assert said[0] == hooks.HEADER and sorted(said[1:]) == ["- My editor is vim", "- Which editor?"]
    assert fire("prompt", {}) == ("", "") and "hook error" in fire("prompt", "not json")[1]
    assert set(json.loads(fire("settings", "", "--command", "x")[0])["hooks"]) == set(hooks.EVENTS)
    monkeypatch.setenv(clients.GUARD, "1")
    assert fire("stop", {"last_assistant_message": "again"}) == ("", "")


def test_tools_and_command_line(spark, tmp_path):
    s = Session.start(spark, str(tmp_path / "m"), "s")
    t = tools.tools(lambda: s)
    assert t["memory_query"]("anything") == "No memories found." and t["memory_log"]("nobody", "x").startswith("Invalid role")
    assert t["memory_log"](" User ", "My editor is vim") == "Logged. Buffer now has 1 entries."
    assert t["memory_consolidate"]() == "Consolidated 1 session(s), 1 new node(s):\n  s: 1 nodes" and t["memory_consolidate"]() == "No pending sessions to consolidate."
    assert "[buffer]" in t["memory_query"]("editor", with_trace=True) and json.loads(t["memory_status"]())["node_count"] == 1
    s.suspend()

    def ran(*argv):
        out = io.StringIO()
        assert main(["--data-dir", str(tmp_path / "m"), *argv], spark, out) == 0
        return out.getvalue()

    # while there are few sessions the raw log tells the same, at a higher score
    assert "source: raw_log" in (said := ran("query", "editor", "--trace", "-k", "2")) and "My editor is vim" in said
    graph = s.memory.query(["editor"], buffer=s.buffer().where("false"), trace=True)
    assert {r.source: r.trace is None for r in retrieval.merged([graph.where("source = 'graph'").withColumn("ordinal", F.lit(1)), graph.where("source = 'raw_log'").withColumn("ordinal", F.lit(1))], 5, True).collect()} == {"raw_log": True}
    assert json.loads(ran("status"))["node_count"] == 1 and ran("snapshot", "list") == "No snapshots found.\n"
    name = ran("snapshot", "create").split()[-1]
    assert "Restored" in ran("snapshot", "restore", "--path", name) and ran("consolidate").startswith("No pending")
    node = s.memory.nodes().first().id
    assert ran("delete", node).startswith(f"Deleted node {node}") and ran("delete", node) == f"Node {node} not found.\n"
    if not pytest.importorskip("importlib.util").find_spec("mcp"):
        with pytest.raises(RuntimeError):
            tools.serve(lambda: s)


def test_older_stores(spark, tmp_path):
    node = {"id": "n", "type": "semantic", "content": "My city is Rome", "embedding": [0.5, 0.25], "strength": {"recency": 1.0, "frequency": 1, "composite": 1.0}, "created_at": "2026-01-01T00:00:00+00:00", "last_accessed": "2026-01-01T00:00:00+00:00", "source_sessions": ["s"], "source_refs": [{"session_id": "s", "message_index": 0}]}
    edge = {"source": "n", "target": "m", "type": "association", "weight": 0.5, "created_at": "2026-01-01T00:00:00+00:00"}
    (tmp_path / "g.json").write_text(json.dumps({"version": "1.0", "nodes": {"n": node}, "edges": [edge]}))
    nodes, edges = legacy.json_graph(spark, str(tmp_path / "g.json"))
    r = nodes.first()
    assert (r.id, r.status, r.confidence, r.valid_from, list(r.embedding), r.aliases) == ("n", "active", 0.6, r.created_at, [0.5, 0.25], []) and edges.first().weight == 0.5
    legacy.write_json_graph(nodes, edges, str(tmp_path / "g2.json"))
    again, links = legacy.json_graph(spark, str(tmp_path / "g2.json"))
    assert again.collect() == nodes.collect() and links.collect() == edges.collect()
    with sqlite3.connect(tmp_path / "g.db") as db:
        db.executescript("CREATE TABLE nodes (id TEXT PRIMARY KEY, data TEXT, embedding BLOB, embed_dim INTEGER); CREATE TABLE edges (source TEXT, target TEXT, type TEXT, weight REAL, created_at TEXT);")
        held = {k: v for k, v in node.items() if k != "embedding"}
        db.execute("INSERT INTO nodes VALUES (?, ?, ?, 2)", ("n", json.dumps(held), np.array([0.5, 0.25], np.float32).tobytes()))
        db.execute("INSERT INTO edges VALUES ('n', 'm', 'association', 0.5, '2026-01-01T00:00:00+00:00')")
    some, lines = legacy.sqlite_graph(spark, str(tmp_path / "g.db"), str(tmp_path / "copy"))
    assert some.collect() == nodes.collect() and lines.collect() == edges.collect()
    (tmp_path / "logs").mkdir()
    for sid in ("s/1 x", "t%"):
        (tmp_path / "logs" / legacy.file_name(sid)).write_text("\n".join(json.dumps({"timestamp": "2026-01-01T00:00:00Z", "role": "user", "content": f"{sid} {i}"}) for i in range(2)) + "\n")
    m = legacy.session_logs(spark, str(tmp_path / "logs"))
    assert sorted((r.session_id, r.message_index, r.content) for r in m.collect()) == [("s/1 x", 0, "s/1 x 0"), ("s/1 x", 1, "s/1 x 1"), ("t%", 0, "t% 0"), ("t%", 1, "t% 1")]
    assert legacy.wal_name("s/1 ä:x") == "s_1_ä_x.wal"
    for held, want in ((["t%"], {"t%": 1}), ({"t%": 7}, {"t%": 7}), ({"t%": {"last_msg_index": 3, "updated_at": "2026-01-01T00:00:00+00:00"}}, {"t%": 3})):
        (tmp_path / "p.json").write_text(json.dumps({"sessions": held}))
        assert {r.session_id: r.last_msg_index for r in legacy.progress(spark, str(tmp_path / "p.json"), m).collect()} == want


def test_expansion_takes_both_ways(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("c", "a", 1.0), ("b", "c", -1.0)], "source string, target string, weight double")
    got = {(r.node, r.association) for r in memory.expanded(spark.createDataFrame([(0, "a")], "query int, node string"), e, DEFAULTS.neighbor_decay).collect()}
    assert got == {("b", 0.3), ("c", 0.6)}
