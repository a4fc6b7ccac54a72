"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the threshold, reassemble by position.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. A key
of at least `least_chars` code points found in at least `least_docs` documents loses all its
lines except those of the largest doc_id that holds it. Null and empty texts are one empty line,
which is too short to drop. A row without a doc_id keeps all its lines and does not count.
Rows with one doc_id count as one document and are cut alike, repeated rows too. Columns besides id and
text pass through `deduplicated` untouched, whatever their names. A very long text is read whole by
one worker. An empty table gives no rows.

Keys travel as 128-bit hashes. Distinct documents are counted in two steps, the first by
(key, document), so a line that a third of all documents hold is summed on the map side
before any task sees it. In the join back, the lines with more than a task's share of
all rows are broadcast (a bounded number of keys, see `spread_join`), the others joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.base import checkpointed, spread_join

_STRIP = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 20, 3


def keys(text: bytes, least_chars: int = LEAST_CHARS) -> list[bytes | None]:
    """For each line its 16-byte key hash, or None if the key is too short."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(_STRIP).lower()  # of bytes: A-Z only
        long = len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _exploded(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                own = {k for k in keys(text, least_chars) if k}
                ids += [doc] * len(own)
                found += own
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(ids, pa.int64())], ["h1", "h2", "doc"])

    return run


def _reassembled(text: bytes, drop: bytes | None, least_chars: int) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    if not drop:
        return text, len(lines), 0
    gone = {drop[i : i + 16] for i in range(0, len(drop), 16)}
    kept = [x for x, k in zip(lines, keys(text, least_chars), strict=True) if k not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def drops(docs: DataFrame, id_col: str, text_col: str, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, drop): for each document that loses lines, the hashes of their keys end to end."""
    light = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("doc IS NOT NULL")
    lines = light.mapInArrow(_exploded(least_chars), "h1 long, h2 long, doc long")
    shared = lines.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("doc").alias("last")).where(F.col("n") >= least_docs)
    hit = spread_join(lines, checkpointed(shared.select("h1", "h2", "rows", "last")), ["h1", "h2"], "rows", "doc").where("doc != last")
    # a long is stored as hashed: its bytes, little end first
    little = lambda c: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 16, "0"), i, 2) for i in range(15, 0, -2)]))
    return hit.groupBy("doc").agg(F.array_agg(F.concat(little("h1"), little("h2"))).alias("parts")).select("doc", F.unhex(F.array_join(F.transform("parts", F.hex), "")).alias("drop"))


def _joined(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_docs: int) -> DataFrame:
    """Each row, whole, with the hashes of the lines that it loses (null: none). The text travels once, inside the row."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").cast("long").alias("__id"))
    gone = drops(docs, id_col, text_col, least_chars, least_docs).select(F.col("doc").alias("__doc"), F.col("drop").alias("__drop"))
    return row.join(gone, F.col("__id") == F.col("__doc"), "left")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row for each document: id, n_lines, n_dropped and kept_sha256."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_reassembled(t, d, least_chars) for t, d in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in done], pa.string())],
                [id_col, "n_lines", "n_dropped", "kept_sha256"],
            )

    light = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    joined = _joined(light, "doc_id", "text", least_chars, least_docs).select("__id", F.coalesce(F.col("__row")["text"], F.lit("")).alias("__text"), "__drop")
    return joined.mapInArrow(run, f"`{id_col}` long, n_lines long, n_dropped long, kept_sha256 string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The documents with their repeated lines gone, all other columns as they came."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, drop: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else _reassembled(t.encode(), d, least_chars)[0].decode() for t, d in zip(text, drop, strict=True)], dtype=object)

    row, drop = F.col("__row"), F.col("__drop")
    # only texts that lose lines go through Python
    new = F.coalesce(cut(F.when(drop.isNotNull(), row[text_col]), drop), row[text_col])
    return _joined(docs, id_col, text_col, least_chars, least_docs).select(*[(new if c == text_col else row[c]).alias(c) for c in docs.columns])
