"""Table schemas, parsed when first asked for (a session must be up)."""

from pyspark.sql.types import StructType

_DDL = {
    "MESSAGE": "timestamp TIMESTAMP, session_id STRING, message_index INT, role STRING, content STRING, metadata MAP<STRING,STRING>",
    "BUFFER_ENTRY": "session_id STRING, type STRING, content STRING, timestamp TIMESTAMP, source_msg INT",
    "NODE": "id STRING, type STRING, content STRING, embedding ARRAY<FLOAT>, embed_model STRING, strength STRUCT<recency: DOUBLE, frequency: BIGINT, composite: DOUBLE>, "
    "created_at TIMESTAMP, last_accessed TIMESTAMP, source_sessions ARRAY<STRING>, source_refs ARRAY<STRUCT<session_id: STRING, message_index: INT>>, access_count BIGINT, "
    "canonical_key STRING, status STRING, supersedes ARRAY<STRING>, valid_from TIMESTAMP, valid_to TIMESTAMP, confidence DOUBLE, entity_type STRING, aliases ARRAY<STRING>, mentioned_dates ARRAY<STRING>",
    "EDGE": "source STRING, target STRING, type STRING, weight DOUBLE, created_at TIMESTAMP",
    "PROGRESS": "session_id STRING, last_msg_index INT, updated_at TIMESTAMP",
    "STAGE2": "memories ARRAY<STRUCT<content: STRING, type: STRING, slot: STRING, valid_from: STRING, valid_to: STRING, confidence: DOUBLE, sources: ARRAY<INT>, supersedes_previous: BOOLEAN>>",
}


def __getattr__(name: str) -> StructType:
    if name in _DDL:
        return StructType.fromDDL(_DDL[name])
    raise AttributeError(name)


#: What a column missing from an older store means; `valid_from` then falls back to created_at.
NODE_DEFAULTS = {"type": "semantic", "content": "", "embed_model": "all-MiniLM-L6-v2", "access_count": 1, "status": "active", "confidence": 0.6}
