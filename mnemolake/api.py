"""The memory as a directory of tables: log, query, consolidate, snapshot, delete, status. `session.py` is one session's view of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake import schema
from mnemolake.config import DEFAULTS, Settings
from mnemolake.durable import kept
from mnemolake.operators import consolidate, deletion, entities, retrieval
from mnemolake.sources import store
from mnemolake.streaming import ingest


class Memory:
    """Tables under one root: messages (JSON log), nodes, edges, progress (versions), access (by version of the nodes), tombstones and ledger (appended).

    `embed` makes vectors, `extract` finds entities, `client` answers a transcript with proposals; each may be left out.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULTS, embed: Callable[[Column], Column] | None = None, extract: entities.Extractor | None = None, client: Callable[[str], str] | None = None) -> None:
        self.spark, self.root, self.settings, self.embed, self.extract, self.client = spark, root.rstrip("/"), settings, embed, extract, client

    # --- tables ---

    def _path(self, name: str):  # noqa: ANN202
        return store._fs(self.spark, f"{self.root}/{name}")

    def _has(self, name: str) -> bool:
        fs, p = self._path(name)
        return fs.exists(p)

    def _table(self, name: str, kind) -> DataFrame:  # noqa: ANN001
        found = store.versions(self.spark, f"{self.root}/{name}")
        return store.read_version(self.spark, f"{self.root}/{name}", found[-1]) if found else self.spark.createDataFrame([], kind)

    def _save(self, name: str, df: DataFrame) -> None:
        store.write_version(df, f"{self.root}/{name}")

    def messages(self) -> DataFrame:
        if not self._has("messages") and self._has("messages_old"):  # a deletion was lost between its two renames
            self._swap("messages", "messages_new" if self._has("messages_new/_SUCCESS") else "messages_old")
        return store.read_messages(self.spark, f"{self.root}/messages") if self._has("messages") else self.spark.createDataFrame([], schema.MESSAGE)

    def _access(self) -> str:
        """Where accesses since the nodes' last version are noted: a new version has the old ones folded in."""
        found = store.versions(self.spark, f"{self.root}/nodes")
        return f"access/{found[-1] if found else 'none'}"

    def nodes(self) -> DataFrame:
        table = self._table("nodes", schema.NODE)
        return retrieval.reinforced(table, self.spark.read.parquet(f"{self.root}/{self._access()}")) if self._has(self._access()) else table

    def edges(self) -> DataFrame:
        return self._table("edges", schema.EDGE)

    # --- log ---

    def log(self, rows: list[tuple[str, str, str]], at: datetime | None = None, metadata: dict[str, str] | None = None) -> None:
        """(session, role, content) rows, numbered on from what is there."""
        new = self.spark.createDataFrame([(i, at or datetime.now(UTC), *r, metadata) for i, r in enumerate(rows)], "n int, timestamp timestamp, session_id string, role string, content string, metadata map<string,string>")
        store.append_messages(store.numbered(new, self.messages(), ["n"]).select(*schema.MESSAGE.names), f"{self.root}/messages")

    def delete_session(self, session_id: str) -> int:
        """Remove a session's messages; how many they were."""
        log = self.messages()
        own = log.where(F.col("session_id") == session_id)
        n = own.count()
        if n:
            self._rewrite_log(own.select("session_id", "message_index"))
        return n

    def _swap(self, name: str, new: str) -> None:
        fs, p = self._path(name)
        fs.rename(self._path(new)[1], p)
        fs.delete(self._path(f"{name}_old")[1], True)

    def _rewrite_log(self, gone: DataFrame) -> None:
        """The log less (session_id, message_index): the new one is written whole, then takes the old one's place."""
        left = self.messages().join(gone, ["session_id", "message_index"], "left_anti")
        fs, p = self._path("messages")
        fs.delete(self._path("messages_new")[1], True)
        left.select(*schema.MESSAGE.names).write.mode("errorifexists").partitionBy("session_id").json(f"{self.root}/messages_new")
        fs.rename(p, self._path("messages_old")[1])
        self._swap("messages", "messages_new")

    # --- consolidation ---

    def pending(self) -> DataFrame:
        return store.pending(self.messages(), self._table("progress", schema.PROGRESS))

    def consolidate_counts(self, now: datetime | None = None, session_id: str | None = None, client: Callable[[str], str] | None = None) -> dict[str, int]:
        """Fold in what is past the progress mark; new nodes of each session that had something pending.

        Edges are written first, then nodes, progress last. Ids come of the content, so a job lost in between
        repeats the batch, writes the same edges and nodes, and changes nothing else.
        """
        at = F.lit(now or datetime.now(UTC)).cast("timestamp")
        progress = self._table("progress", schema.PROGRESS)
        new = store.pending(self.messages(), progress)
        new = kept(new if session_id is None else new.where(F.col("session_id") == session_id))
        if new.isEmpty():
            return {}
        before = kept(self.nodes())
        after, edges = consolidate.batch(new, before, at, self.embed, self.settings, self.extract, client or self.client)
        old = self.edges()
        more = edges.select(*schema.EDGE.names).join(old.select("source", "target", "type"), ["source", "target", "type"], "left_anti")
        self._save("edges", old.unionByName(more.select(*schema.EDGE.names)))
        self._save("nodes", after)
        self._save("progress", store.advanced(progress, new, at).select(*schema.PROGRESS.names))
        made = self._table("nodes", schema.NODE).join(before.select("id"), "id", "left_anti").groupBy(F.get("source_sessions", 0).alias("session_id")).agg(F.count(F.lit(1)).alias("n"))
        counted = new.select("session_id").distinct().join(made, "session_id", "left")
        return {r.session_id: r.n or 0 for r in counted.orderBy("session_id").collect()}

    def consolidate(self, now: datetime | None = None) -> int:
        return sum(self.consolidate_counts(now).values())

    # --- retrieval ---

    def query(self, texts: list[str], as_of: datetime | None = None, include_history: bool = False, now: datetime | None = None, session_id: str | None = None, buffer: DataFrame | None = None, k: int | None = None, trace: bool = False, semantic: bool = True) -> DataFrame:
        """Results of a batch of questions; active nodes that were ranked count as accessed. `buffer`: entries to search, else those of the log, of one session if it is named."""
        s = self.settings if k is None else replace(self.settings, k=k)
        asked = self.spark.createDataFrame(list(enumerate(texts)), "query int, text string")
        semantic = semantic and self.embed is not None
        if semantic:
            asked = kept(asked.withColumn("embedding", self.embed(F.col("text"))))
        moment = F.lit(as_of).cast("timestamp") if as_of else None
        at = F.lit(now or datetime.now(UTC)).cast("timestamp")
        log = self.messages()
        live = buffer if buffer is not None else ingest.buffer_entries(log if session_id is None else log.where(F.col("session_id") == session_id))
        ranked = kept(retrieval.graph(self.nodes(), self.edges(), asked, at, moment, include_history, s, semantic, every=True))
        used = ranked.where("status = 'active'").select("node_id", at.alias("at"))
        if not used.isEmpty():
            used.write.mode("append").parquet(f"{self.root}/{self._access()}")
        parts = [retrieval.buffered(live, asked, moment, s, include_history), ranked.where(F.col("ordinal") <= s.k)]
        if log.select("session_id").distinct().count() < s.cold_start_sessions:
            parts.append(retrieval.raw_log(log, asked, moment, s))
        return retrieval.merged(parts, s.k, trace)

    # --- snapshots ---

    def snapshot(self, buffer: DataFrame | None = None) -> str:
        """A version of the nodes, edges and, if given, a buffer, under one name."""
        name = store.write_version(self.nodes(), f"{self.root}/snapshots")
        store.write_version(self.edges(), f"{self.root}/snapshot_edges", name)
        if buffer is not None:
            store.write_version(buffer, f"{self.root}/snapshot_buffers", name)
        return name

    def snapshots(self) -> list[str]:
        """Names, the newest first."""
        return store.versions(self.spark, f"{self.root}/snapshots")[::-1]

    def restore(self, name: str | None = None) -> DataFrame:
        """Put a snapshot (the newest, if none is named) in place of nodes and edges; its buffer."""
        name = name or self.snapshots()[0]
        read = lambda part, kind: store.read_version(self.spark, f"{self.root}/{part}", name) if name in store.versions(self.spark, f"{self.root}/{part}") else self.spark.createDataFrame([], kind)
        self._save("edges", read("snapshot_edges", schema.EDGE))
        self._save("nodes", store.read_version(self.spark, f"{self.root}/snapshots", name))
        return read("snapshot_buffers", schema.BUFFER_ENTRY)

    def _scrub(self, gone: DataFrame) -> int:
        """Take deleted nodes, and what has their content, out of all snapshots; how many had some."""
        touched = 0
        for name in self.snapshots():
            path = f"{self.root}/snapshots"
            held = store.read_version(self.spark, path, name)
            clean = kept(deletion.rows_without(deletion.nodes_without(held, gone), gone))
            parts = [("snapshots", clean, held.count() - clean.count())]
            if name in store.versions(self.spark, f"{self.root}/snapshot_edges"):
                out = held.select("id").join(clean.select("id"), "id", "left_anti").unionByName(gone.select("id"))
                parts.append(("snapshot_edges", kept(deletion.edges_without(store.read_version(self.spark, f"{self.root}/snapshot_edges", name), out)), 0))
            if name in store.versions(self.spark, f"{self.root}/snapshot_buffers"):
                entries = store.read_version(self.spark, f"{self.root}/snapshot_buffers", name)
                left = kept(deletion.rows_without(entries, gone))
                parts.append(("snapshot_buffers", left, entries.count() - left.count()))
            if sum(n for *_, n in parts):
                touched += 1
                for part, df, _ in parts:  # each was read whole before one is replaced
                    df.write.mode("overwrite").parquet(f"{self.root}/{part}/{name}")
        return touched

    # --- deletion ---

    def delete(self, node_ids: list[str], now: datetime | None = None, buffer_removed: int = 0) -> DataFrame:
        """Remove nodes with their edges, messages and snapshot copies; returns the tombstones. A ledger row tells what was removed."""
        at = F.lit(now or datetime.now(UTC)).cast("timestamp")
        nodes, edges = self.nodes(), self.edges()
        gone = kept(nodes.where(F.col("id").isin(node_ids)))
        if gone.isEmpty():
            return self.spark.createDataFrame([], deletion.tombstones(gone, edges, at).schema)
        stones = kept(deletion.tombstones(gone, edges, at).join(gone.select(F.col("id").alias("node_id"), deletion.strategy(F.col("source_refs")).alias("match_strategy")), "node_id"))
        said = kept(deletion.messages_of(self.messages(), gone))
        removed = said.count()
        self._rewrite_log(said)
        touched = self._scrub(gone)
        self._save("edges", deletion.edges_without(edges, gone))
        self._save("nodes", deletion.nodes_without(nodes, gone))
        stones.write.mode("append").parquet(f"{self.root}/tombstones")
        ledger = stones.select(F.sha2(F.concat_ws("|", F.lit("ledger"), "tombstone_id"), 256).alias("record_id"), "timestamp", "node_id", F.lit(True).alias("node_deleted"), "edges_removed", F.lit(removed).alias("log_entries_removed"), F.lit(buffer_removed).alias("buffer_entries_removed"), F.lit(touched).alias("snapshots_touched"), "tombstone_id")
        ledger.write.mode("append").parquet(f"{self.root}/ledger")
        return self.spark.read.parquet(f"{self.root}/tombstones").where(F.col("node_id").isin(node_ids))

    def ledger(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/ledger")

    def status(self) -> dict[str, int]:
        log = self.messages().agg(F.count(F.lit(1)).alias("m"), F.count_distinct("session_id").alias("s")).first()
        return {"nodes": self.nodes().count(), "edges": self.edges().count(), "messages": log.m, "sessions": log.s}
