"""Which tracked places of a corpus hold a value that occurs anywhere else: an exchange of compressed sorted hashes.

Rows are not shuffled one by one. A task sorts the hashes of some million places, settles what
repeats among them itself, and sends each bucket of the hash space one payload: hashes it has
met, and tracked hashes met once with their places. A hash that a third of all places share is
thus one entry of a payload, not a row each. What a bucket finds goes back as payloads too, keyed
by the group of documents that the place belongs to.

Groups and buckets are as many as the bytes of the corpus ask for, whatever the number of
partitions: a group's texts and a bucket's payloads are what a worker holds at once, and a
partition's groups and buckets come one after the other, sorted by Spark, which spills.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.base import U64, packed, partitions, steps, unpacked, unsteps

#: Documents and bytes of a group, on average; bytes of text to a bucket.
GROUP, GROUP_BYTES, BUCKET_BYTES = 600, 4 << 20, 16 << 20
FLUSH = 1_500_000
SENT = "bucket int, kind int, g int, blob binary"
BACK = "g int, blob binary"
I64, I32, U32 = np.int64, np.int32, np.uint32


@dataclass(frozen=True)
class Deal:
    """How many groups of documents and buckets of values there are, and the text's bytes."""

    groups: int
    buckets: int
    bytes: int


def grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Deal]:
    """(doc_id, text, uid, g) and the deal. uid and g are two hashes of id and text: rows alike in both are treated alike, and two others would have to agree in both hashes to be mistaken for each other."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    light = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    n, size = docs.select(F.octet_length(text).alias("size")).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = max(1, n // GROUP, size // GROUP_BYTES)
    deal = Deal(groups, max(partitions(docs.sparkSession), size // BUCKET_BYTES), size)
    return light.withColumn("g", F.pmod(F.xxhash64(F.lit("group"), "doc_id", "text"), F.lit(groups)).cast("int")), deal


def hash_bits(places: float) -> int:
    """Bits of a hash that make a chance meeting rarer than one in some thousands of places; what meets is checked later."""
    return int(min(64, max(32, math.ceil(math.log2(max(places, 2))) + 13)))


def bucket_cuts(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted 64-bit hashes: buckets divide the hash space evenly."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], dtype=U64)
    return np.append(np.searchsorted(ordered, edges), len(ordered))


def by_group(g: np.ndarray, uid: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Payloads (g, uid table, index, more...) of places."""
    if not len(uid):
        return
    order = np.argsort(g, kind="stable")
    g = g[order]
    cut = np.flatnonzero(np.diff(g, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(g)), strict=True):
        at = order[a:b]
        table, index = np.unique(uid[at], return_inverse=True)
        put = np.lexsort((more[0][at], index))
        yield int(g[a]), packed(table, index[put].astype(U32), *[x[at][put].astype(I32) for x in more])


def places(blobs: list[bytes], more: int = 1) -> list[np.ndarray]:
    """uid and the other arrays of payloads made by by_group, sorted by uid."""
    out = [[np.zeros(0, I64)], *[[np.zeros(0, I32)] for _ in range(more)]]
    for blob in blobs:
        table, index, *rest = unpacked(blob, I64, U32, *[I32] * more)
        out[0].append(table[index])
        for k, x in enumerate(rest):
            out[k + 1].append(x)
    whole = [np.concatenate(x) for x in out]
    order = np.lexsort((whole[1], whole[0]))
    return [x[order] for x in whole]


def sent(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "g", "blob"])


def back(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], ["g", "blob"])


def passed(rows: Iterator[tuple[int, bytes]], buckets: int) -> list[tuple[int, int, int, bytes]]:
    """Rows of `sent` that no bucket need look at."""
    return [(g % buckets, 1, g, blob) for g, blob in rows]


def dealt(rows: DataFrame, settle) -> DataFrame:  # noqa: ANN001
    """settle(payloads of one bucket) -> payloads by group, for each bucket in turn; what is settled already passes through."""
    n = partitions(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = -1
        for batch in batches:
            for bucket, kind, g, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if kind:
                    yield back([(g, blob.as_py())])
                    continue
                if bucket != now and held:
                    yield back(list(settle(held)))
                    held = []
                now = bucket
                held.append(blob.as_py())
        if held:
            yield back(list(settle(held)))

    return rows.repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("kind", "bucket").mapInArrow(run, BACK)


def flushed(h: np.ndarray, g: np.ndarray, uid: np.ndarray, pos: np.ndarray, others: np.ndarray, buckets: int, bits: int) -> pa.RecordBatch:
    """Payloads for tracked places and for other hashes that were met."""
    met, count = np.unique(np.concatenate([h, others]), return_counts=True)
    once = count[np.searchsorted(met, h)] == 1
    rows = passed(by_group(g[~once], uid[~once], pos[~once]), buckets)
    order = np.argsort(h[once], kind="stable")
    th, tg, tu, tp = h[once][order], g[once][order], uid[once][order], pos[once][order]
    lone = np.zeros(len(met), bool)
    lone[np.searchsorted(met, th)] = True
    rest = met[~lone]
    cut_t, cut_r, shift = bucket_cuts(th, buckets), bucket_cuts(rest, buckets), U64(64 - bits)
    for b in range(buckets):
        t, r = slice(cut_t[b], cut_t[b + 1]), slice(cut_r[b], cut_r[b + 1])
        if t.start == t.stop and r.start == r.stop:
            continue
        table, first, index = np.unique(tu[t], return_index=True, return_inverse=True)
        rows.append((b, 0, -1, packed(steps(rest[r] >> shift), steps(th[t] >> shift), table, tg[t][first].astype(I32), index.astype(U32), tp[t].astype(I32))))
    return sent(rows)


def flushes(parts: Iterator[tuple[np.ndarray, ...]], buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """`flushed` for each million or so of the places in (h, g, uid, pos, others)."""
    held: list[tuple] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0]) + len(part[4])
        if size >= FLUSH:
            yield flushed(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets, bits)
            held, size = [], 0
    if size:
        yield flushed(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets, bits)


def _repeated(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    seen, held = [np.zeros(0, U64)], []
    for blob in blobs:
        rest, th, table, groups, index, pos = unpacked(blob, U64, U64, I64, I32, U32, I32)
        seen.append(unsteps(rest))
        held.append((unsteps(th), groups[index], table[index], pos) if len(table) else (np.zeros(0, U64), np.zeros(0, I32), np.zeros(0, I64), np.zeros(0, I32)))
    h, g, uid, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    met, count = np.unique(np.concatenate([*seen, h]), return_counts=True)
    hit = count[np.searchsorted(met, h)] > 1
    yield from by_group(g[hit], uid[hit], pos[hit])


def repeated(rows: DataFrame) -> DataFrame:
    """From payloads of `flushed`, (g, blob): the tracked places whose hash is met elsewhere."""
    return dealt(rows, _repeated)


def texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """The uids and texts of a group."""
    return table["uid"].to_numpy(), table["text"].cast(pa.binary()).to_pylist()
