"""Tools for a model: each takes plain values and returns text. `serve` offers them over the Model Context Protocol where its library is installed."""

from __future__ import annotations

import json
from collections.abc import Callable

from mnemolake.session import ROLES, Session


def tools(session: Callable[[], Session]) -> dict[str, Callable[..., str]]:
    """The tools by name; `session` gives the one that they all work on."""

    def memory_query(query: str, k: int = 10, include_history: bool = False, with_trace: bool = False, as_of: str | None = None) -> str:
        """Search long-term memory. as_of: an ISO-8601 moment to answer for."""
        found = session().query(query, k, include_history, with_trace, as_of)
        lines = []
        for i, r in enumerate(found, 1):
            lines.append(f"{i}. [{r.source}] (score: {r.score:.3f}) {r.content}")
            if with_trace and r.trace:
                lines.append(f"   trace={json.dumps(r.trace.asDict(), sort_keys=True)}")
        return "\n".join(lines) or "No memories found."

    def memory_log(role: str, content: str) -> str:
        """Log a message; role is user, assistant, tool_call or tool_result."""
        if (name := role.lower().strip()) not in ROLES:
            return f"Invalid role {role!r}. Expected one of: {', '.join(ROLES)}."
        session().log(name, content)
        return f"Logged. Buffer now has {len(session().entries)} entries."

    def memory_consolidate() -> str:
        """Fold all pending messages into memory."""
        done = session().consolidate()
        if not done:
            return "No pending sessions to consolidate."
        return "\n".join([f"Consolidated {len(done)} session(s), {sum(done.values())} new node(s):", *(f"  {s}: {n} nodes" for s, n in done.items())])

    def memory_status() -> str:
        """Counters of the memory."""
        return json.dumps(session().status(), indent=2)

    def memory_snapshot_create() -> str:
        """Snapshot the memory, as a backup."""
        return f"Snapshot created: {session().create_snapshot()}"

    def memory_delete_node(node_id: str) -> str:
        """Remove a node and all that it came from."""
        r = session().delete_node(node_id)
        if not r.node_deleted:
            return f"Node {node_id} not found."
        own = f" Affected sessions: {', '.join(r.affected_sessions)}." if r.affected_sessions else ""
        return f"Deleted node {node_id}. Edges removed: {r.edges_removed}, Log entries removed: {r.log_entries_removed}, Buffer entries removed: {r.buffer_entries_removed}, match strategy: {r.match_strategy}, snapshots touched: {r.snapshots_touched}.{own}"

    return {f.__name__: f for f in (memory_query, memory_log, memory_consolidate, memory_status, memory_snapshot_create, memory_delete_node)}


def serve(session: Callable[[], Session], name: str = "mnemolake") -> None:
    try:
        from mcp.server.fastmcp import FastMCP
    except ImportError as e:
        raise RuntimeError("the mcp library is not installed") from e
    server = FastMCP(name)
    for f in tools(session).values():
        server.tool()(f)
    server.run(transport="stdio")
