"""One session's view of a memory: its messages, its buffer with a write-ahead copy, its questions."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from mnemolake import schema
from mnemolake.api import Memory
from mnemolake.config import DEFAULTS, Settings
from mnemolake.functions.text import folded
from mnemolake.operators import deletion
from mnemolake.sources import legacy, store
from mnemolake.streaming import ingest

ROLES = ("user", "assistant", "tool_call", "tool_result")


@dataclass
class Deletion:
    """What a hard deletion removed."""

    node_deleted: bool = False
    edges_removed: int = 0
    log_entries_removed: int = 0
    buffer_entries_removed: int = 0
    affected_sessions: list[str] = field(default_factory=list)
    match_strategy: str = "none"
    exact_matches_removed: int = 0
    snapshots_touched: int = 0
    tombstone_id: str | None = None
    ledger_record_id: str | None = None

    def to_dict(self) -> dict:
        return asdict(self)


class Session:
    """A session over a `Memory`. The buffer is what this session's messages gave, a few rows; it is written ahead every flush interval and on leaving, and found again by the next start."""

    def __init__(self, memory: Memory, session_id: str) -> None:
        self.memory, self.session_id, self.spark = memory, session_id, memory.spark
        self.entries: list[Row] = []
        self.changed = self.closed = False
        self.flushed_at = time.monotonic()

    @classmethod
    def start(cls, spark: SparkSession, root: str, session_id: str | None = None, settings: Settings = DEFAULTS, embed: Callable[[Column], Column] | None = None, extract=None, client: Callable[[str], str] | None = None) -> Session:  # noqa: ANN001
        """A new session or, under a known id, the one that was left; its buffer is recovered."""
        s = cls(Memory(spark, root, settings, embed, extract, client), session_id or str(uuid.uuid4()))
        s.recover()
        return s

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *what: object) -> None:
        self.end()

    # --- buffer ---

    @property
    def _wal(self) -> str:
        return f"{self.memory.root}/wal/{legacy.wal_name(self.session_id)}"

    def buffer(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(e) for e in self.entries], schema.BUFFER_ENTRY)

    def by_type(self, kind: str) -> list[Row]:
        return [e for e in self.entries if e.type == kind]

    def remove_where(self, condition: Column) -> int:
        """Take entries out of the buffer; how many they were."""
        left = self.buffer().where(~F.coalesce(condition, F.lit(False))).collect()
        n = len(self.entries) - len(left)
        self.entries, self.changed = left, self.changed or n > 0
        return n

    def flush(self, force: bool = False) -> bool:
        """Write the buffer ahead, if it changed; whether it was written."""
        if not (self.changed or force):
            return False
        name = store.write_version(self.buffer(), self._wal)
        fs, p = store._fs(self.spark, self._wal)
        for old in store.versions(self.spark, self._wal):
            if old < name:
                fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, old), True)
        self.changed, self.flushed_at = False, time.monotonic()
        return True

    def recover(self) -> int:
        """Entries of the write-ahead copy, if there is one; how many."""
        if not store.versions(self.spark, self._wal):
            return 0
        self.entries = store.read_version(self.spark, self._wal).orderBy("source_msg").collect()
        return len(self.entries)

    def clear(self) -> None:
        """Discard the write-ahead copy."""
        fs, p = store._fs(self.spark, self._wal)
        fs.delete(p, True)
        self.changed = False

    # --- lifecycle ---

    def suspend(self) -> None:
        """Keep all that is needed to go on later."""
        if not self.closed:
            self.closed = True
            self.flush()

    def end(self) -> None:
        """Leave for good: the write-ahead copy goes."""
        if not self.closed:
            self.suspend()
            self.clear()

    # --- log and questions ---

    def log(self, role: str, content: str, metadata: dict[str, str] | None = None, at: datetime | None = None) -> None:
        at = at or datetime.now(UTC)
        self.memory.log([(self.session_id, role, content)], at, metadata)
        if role in ingest.BUFFERED_ROLES:
            last = self.memory.messages().where(F.col("session_id") == self.session_id).orderBy(F.col("message_index").desc()).limit(1)
            found = ingest.buffer_entries(last).collect()
            self.entries, self.changed = [*self.entries, *found], self.changed or bool(found)
        if time.monotonic() - self.flushed_at >= self.memory.settings.flush_seconds:
            self.flush()

    def query(self, text: str, k: int | None = None, include_history: bool | None = None, with_trace: bool = False, as_of: str | datetime | None = None, semantic: bool = True, now: datetime | None = None) -> list[Row]:
        """The k best memories, best first: node_id, content, score, source, rank and, if asked for, trace."""
        moment = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
        if moment is not None and moment.tzinfo is None:
            moment = moment.replace(tzinfo=UTC)
        history = self.memory.settings.include_history if include_history is None else include_history
        return self.memory.query([text], moment, history, now, buffer=self.buffer(), k=k, trace=with_trace, semantic=semantic).orderBy("rank").collect()

    def consolidate(self, now: datetime | None = None) -> dict[str, int]:
        """All sessions that have something pending: new nodes of each."""
        return self.memory.consolidate_counts(now)

    def consolidate_current(self, now: datetime | None = None) -> int:
        return self.memory.consolidate_counts(now, self.session_id).get(self.session_id, 0)

    # --- deletion and snapshots ---

    def delete_node(self, node_id: str) -> Deletion:
        """Remove a node and all that it came from: edges, messages, buffer entries, snapshot copies."""
        nodes, log = self.memory.nodes(), self.memory.messages()
        gone = nodes.where(F.col("id") == node_id)
        node = gone.first()
        if node is None:
            return Deletion()
        said = deletion.messages_of(log, gone).collect()
        own = [r.message_index for r in (node.source_refs or []) if r.session_id == self.session_id]
        match = F.col("source_msg").isin(own) if own else folded(F.col("content")) == folded(F.lit(node.content))
        out = self.remove_where(match)
        self.flush()
        stone = self.memory.delete([node_id], buffer_removed=out).orderBy(F.col("timestamp").desc()).first()
        row = self.memory.ledger().where(F.col("tombstone_id") == stone.tombstone_id).first()
        exact = stone.match_strategy == "exact_content"
        return Deletion(True, row.edges_removed, len(said), out, sorted({r.session_id for r in said}), stone.match_strategy, len(said) if exact else 0, row.snapshots_touched, stone.tombstone_id, row.record_id)

    def create_snapshot(self) -> str:
        return self.memory.snapshot(self.buffer())

    def snapshots(self) -> list[str]:
        return self.memory.snapshots()

    def restore_snapshot(self, name: str | None = None) -> None:
        self.entries = self.memory.restore(name).orderBy("source_msg").collect()
        self.flush(force=True)

    def status(self) -> dict[str, int | str]:
        s = self.memory.status()
        own = self.memory.messages().where(F.col("session_id") == self.session_id).count()
        return {"session_id": self.session_id, "node_count": s["nodes"], "edge_count": s["edges"], "buffer_entries": len(self.entries), "total_sessions": s["sessions"], "log_messages": own}
