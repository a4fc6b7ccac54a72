"""Substring dedup by fixed-block anchors: index non-overlapping blocks, probe them with every rolling window, extend hits to maximal exact repeats.

A window is WINDOW (35) consecutive words `[^\\x20\\x09-\\x0D]+` of one document, unchanged. Any
window holds a whole block of BLOCK (18) words at a multiple of 18, so a window that repeats
has a block whose words occur, at some offset, elsewhere.
1. The blocks are indexed by hash, and all rolling windows of 18 words probe them.
2. Where a block is hit, it is extended to the windows whose first block it is; those whose 64-bit
   hash is met elsewhere go on. Hashes only choose what is compared.
3. The words themselves are then compared. A window's anchor is the 18 words in it of least hash, a
   function of its words, so equal windows have equal anchors. Neighbouring windows of one
   anchor travel as one stretch of words; stretches that are equal as a whole are settled at
   once, in the task that sends them or in the anchor's bucket, and of unequal ones at one
   anchor each window is looked up by its words.
Windows found run together to maximal exact repeats; each word they cover is removed, judged on
the input alone.

Null and empty texts have no words. Rows alike in id and text are repeats of each other, as any
two documents. A passage that very many documents share is one hash of a payload and one
stretch a task, not a row each. A very long text is read whole by one worker, with the few
others of its group (see anchors.py). Which of equal rows comes first does not matter, nor do columns
besides id and text, which are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemolake.llm import anchors
from mnemolake.llm.base import U64, flat, mix, packed, passes, plain_words, sequence_windows, span_hashes, unpacked, word_spans

WINDOW = 35
BLOCK = (WINDOW + 1) // 2
I64, I32, U32, U8 = np.int64, np.int32, np.uint32, np.uint8
#: Stretches of words that a task gathers before it sends them.
STRETCHES = 60_000
STRETCH = "key long, lead int, n int, uid long, g int, pos int, words binary"


def _blocks(buckets: int, bits: int):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            uids, groups = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, at = flat(batch.column(1))
            for i, j in passes(at):
                part = data[at[i] : at[j]]
                start, end, first = word_spans(part, at[i : j + 1] - at[i])
                w = sequence_windows(span_hashes(part, start, end), BLOCK)
                n = np.diff(first)
                row = np.repeat(np.arange(j - i), n)
                place = np.arange(len(row)) - first[:-1][row]
                fits = (place + BLOCK <= n[row])[: len(w)]
                block = fits & (place % BLOCK == 0)[: len(w)]
                of = row[: len(w)][block]
                yield w[block], groups[i:j][of], uids[i:j][of], place[: len(w)][block], w[fits & ~block]

    return lambda batches: anchors.flushes(parts(batches), buckets, bits)


def _parts(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(uids, bytes, offsets) of parts of a group."""
    uids = table["uid"].to_numpy()
    data, at = flat(table["text"])
    for i, j in passes(at):
        yield uids[i:j], data[at[i] : at[j]], at[i : j + 1] - at[i]


def _hit(uids: np.ndarray, uid: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, places) of the rows that have some."""
    a, b = np.searchsorted(uid, uids), np.searchsorted(uid, uids, "right")
    for d in np.flatnonzero(a < b):
        yield int(d), np.unique(pos[a[d] : b[d]]).astype(I64)


def _windows(docs: pa.Table, hits: pa.Table) -> pa.Table:
    """One row: the hashes and places of a group's windows whose first block is hit."""
    uid, pos = anchors.places(hits["blob"].to_pylist())
    got = [(np.zeros(0, U64), np.zeros(0, I64), np.zeros(0, I64))]
    for uids, data, at in _parts(docs) if len(uid) else ():
        some = list(_hit(uids, uid, pos))
        if not some:
            continue
        start, end, first = word_spans(data, at)
        h = sequence_windows(span_hashes(data, start, end), WINDOW)
        for d, block in some:
            p = (block[:, None] - np.arange(BLOCK - 1, -1, -1)[None, :]).ravel()
            p = p[(p >= 0) & (p + WINDOW <= first[d + 1] - first[d])]
            got.append((h[first[d] + p], np.full(len(p), uids[d], I64), p))
    h, u, p = (np.concatenate(x) for x in zip(*got, strict=True))
    some = [int(docs["g"][0].as_py())] if len(h) else []
    return pa.table({"g": pa.array(some, pa.int32()), "blob": pa.array([b"".join(x.tobytes() for x in (h, u, p))] * len(some), pa.binary())})


def _gathered(buckets: int):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for g, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, u, p = np.frombuffer(blob.as_py(), I64).reshape(3, -1)
                yield h.view(U64), np.full(len(h), g, I32), u, p, np.zeros(0, U64)

    return lambda batches: anchors.flushes(parts(batches), buckets, 64)


def _stretches(docs: pa.Table, flags: pa.Table) -> pa.Table:
    """The words of a group's windows that go on, those of one anchor together."""
    uid, pos = anchors.places(flags["blob"].to_pylist())
    keys, leads, counts, owners, firsts, texts = [], [], [], [], [], []
    for uids, data, at in _parts(docs) if len(uid) else ():
        some = list(_hit(uids, uid, pos))
        if not some:
            continue
        start, end, first = word_spans(data, at)
        h = sequence_windows(span_hashes(data, start, end), BLOCK)
        for d, p in some:
            whole = first[d] + p
            anchor = np.concatenate([h[w[:, None] + np.arange(BLOCK)[None, :]].argmin(1) for w in np.array_split(whole, 1 + len(whole) // 4096)]) + whole
            cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(p) != 1)])
            words = plain_words(data[at[d] : at[d + 1]].tobytes())
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(p)], strict=True):
                texts.append(b" ".join(words[p[a] : p[b - 1] + WINDOW]))
            keys.append(mix(h[anchor[cut]]).view(I64))  # least hashes lie close together: mixed, they fill all buckets alike
            leads.append(anchor[cut] - whole[cut])
            counts.append(np.diff(np.append(cut, len(p))))
            owners.append(np.full(len(cut), uids[d]))
            firsts.append(p[cut])
    g = docs["g"][0].as_py() if len(docs) else 0
    column = lambda x, t: pa.array(np.concatenate([*x, np.zeros(0, I64)]).astype(t))
    return pa.table([column(keys, I64), column(leads, I32), column(counts, I32), column(owners, I64), pa.array(np.full(len(texts), g, I32)), column(firsts, I32), pa.array(texts, pa.binary())], ["key", "lead", "n", "uid", "g", "pos", "words"])


class Settled:
    """Gathers stretches; those equal as a whole are settled, one of each is kept."""

    def __init__(self) -> None:
        #: (key, lead, n, words) -> who has it: one (uid, g, pos), or None once settled.
        self.kept: dict[tuple[int, int, int, bytes], tuple[int, int, int] | None] = {}
        self.found: list[tuple[int, int, int, int]] = []  # g, uid, pos, n

    def add(self, key: int, lead: int, n: int, words: bytes, owner: tuple[int, int, int] | None) -> None:
        name = (key, lead, n, words)
        if name not in self.kept:
            self.kept[name] = owner
            return
        for uid, g, pos in (self.kept[name], owner):
            if uid is not None:
                self.found.append((g, uid, pos, n))
        self.kept[name] = _NOBODY

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """Payloads by group of the windows that were found."""
        if not self.found:
            return
        g, uid, pos, n = np.array(self.found, I64).T
        each = np.repeat(np.arange(len(n)), n)
        run = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        yield from anchors.by_group(g[each], uid[each], pos[each] + run)


_NOBODY = (None, None, None)


def _shipped(buckets: int):
    """A mapper of stretches to payloads by the anchor's bucket."""

    def shipped(held: Settled) -> pa.RecordBatch:
        rows = anchors.passed(held.rows(), buckets)
        by: dict[int, list] = defaultdict(list)
        for name, owner in held.kept.items():
            by[(name[0] % 2**64) * buckets >> 64].append((*name, *owner))
        for bucket, items in by.items():
            items.sort(key=lambda x: x[3])
            key, lead, n, words, uid, g, pos = zip(*items, strict=True)
            some = np.array([u is not None for u in uid], U8)
            numbers = [np.array([x or 0 for x in column], kind) for column, kind in ((uid, I64), (g, I32), (pos, I32))]
            text = b"".join(words)
            zipped = np.frombuffer(pa.compress(text, "zstd", asbytes=True), U8) if text else np.zeros(0, U8)
            rows.append((bucket, 0, -1, packed(np.array(key, I64), np.array(lead, U8), np.array(n, U8), np.array([len(w) for w in words], I32), some, *numbers, zipped)))
        return anchors.sent(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Settled()
        for batch in batches:
            for key, lead, n, uid, g, pos, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.add(key, lead, n, words, (uid, g, pos))
            if len(held.kept) + len(held.found) >= STRETCHES:
                yield shipped(held)
                held = Settled()
        if held.kept:
            yield shipped(held)

    return run


def _compared(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The windows of a bucket whose words are met elsewhere, as payloads by group."""
    held = Settled()
    for blob in blobs:
        key, lead, n, size, some, uid, g, pos, zipped = unpacked(blob, I64, U8, U8, I32, U8, I64, I32, I32, U8)
        ends = np.cumsum(size, dtype=I64)
        text = pa.decompress(zipped.tobytes(), int(ends[-1]), "zstd", asbytes=True)
        owners = zip(uid.tolist(), g.tolist(), pos.tolist(), strict=True)
        for k, l, m, a, b, known, owner in zip(key.tolist(), lead.tolist(), n.tolist(), (ends - size).tolist(), ends.tolist(), some.tolist(), owners, strict=True):
            held.add(k, l, m, text[a:b], owner if known else _NOBODY)
    by: dict[int, list] = defaultdict(list)
    for (key, lead, n, words), owner in held.kept.items():
        by[key].append((lead, n, words, owner))
    for stretches in by.values():
        if len(stretches) < 2:
            continue
        seen: dict[bytes, tuple[int, int, int]] = {}
        twice: set[bytes] = set()
        for lead, n, words, owner in stretches:
            own = words.split(b" ")
            for k in range(n):
                window = b" ".join(own[k : k + WINDOW])
                mine = (owner[0], owner[1], owner[2] + k) if owner[0] is not None else _NOBODY
                if window not in seen:
                    seen[window] = mine
                    continue
                for uid, g, pos in (mine,) if window in twice else (mine, seen[window]):
                    if uid is not None:
                        held.found.append((g, uid, pos, 1))
                twice.add(window)
    yield from held.rows()


def repeats(docs: DataFrame, deal: anchors.Deal) -> DataFrame:
    """(g, blob): the starts, as word numbers, of all windows whose words start anywhere else."""
    by = docs.groupBy("g")  # with all columns each time, so that the texts are exchanged once
    hits = anchors.repeated(docs.select("uid", "text", "g").mapInArrow(_blocks(deal.buckets, anchors.hash_bits(deal.bytes / 4)), anchors.SENT))
    met = anchors.repeated(by.cogroup(hits.groupBy("g")).applyInArrow(_windows, anchors.BACK).mapInArrow(_gathered(deal.buckets), anchors.SENT))
    words = by.cogroup(met.groupBy("g")).applyInArrow(_stretches, STRETCH).mapInArrow(_shipped(deal.buckets), anchors.SENT)
    return anchors.dealt(words, _compared)


def removed_words(docs: DataFrame, finish, schema: str, id_col: str, text_col: str) -> DataFrame:
    """finish(doc_ids, bytes, offsets, starts, ends, first, gone) -> RecordBatch for parts of the documents."""
    light, deal = anchors.grouped(docs, id_col, text_col)

    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        uid, pos = anchors.places(flags["blob"].to_pylist())
        ids, at_row, out = texts["doc_id"].combine_chunks(), 0, []
        for uids, data, at in _parts(texts):
            start, end, first = word_spans(data, at)
            edge = np.zeros(len(start) + 1, I64)
            for d, p in _hit(uids, uid, pos):
                edge[first[d] + p] += 1
                edge[first[d] + p + WINDOW] -= 1
            out.append(finish(ids[at_row : at_row + len(uids)], data, at, start, end, first, np.cumsum(edge[:-1]) > 0))
            at_row += len(uids)
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([finish(ids[:0], np.zeros(0, np.uint8), np.zeros(1, I64), *[np.zeros(0, I64)] * 2, np.zeros(1, I64), np.zeros(0, bool))])

    return light.groupBy("g").cogroup(repeats(light, deal).groupBy("g")).applyInArrow(run, schema)


def _kept(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    return b" ".join([raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, n_removed and kept_sha256 (of the kept words, one space between)."""

    def finish(ids, data, at, start, end, first, gone):  # noqa: ANN001, ANN202
        n = np.diff(first)
        removed = [int(gone[a:b].sum()) for a, b in zip(first[:-1], first[1:], strict=True)]
        raw, sha = data.tobytes(), []
        for a, b in zip(first[:-1], first[1:], strict=True):
            keep = ~gone[a:b]
            sha.append(hashlib.sha256(_kept(raw, start[a:b][keep], end[a:b][keep])).hexdigest())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"])

    return removed_words(docs, finish, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string", id_col, text_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): what is left of each text, its words joined by one space."""

    def finish(ids, data, at, start, end, first, gone):  # noqa: ANN001, ANN202
        raw = data.tobytes()
        left = [_kept(raw, start[a:b][~gone[a:b]], end[a:b][~gone[a:b]]).decode() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array(left, pa.string())], [id_col, text_col])

    return removed_words(docs, finish, f"`{id_col}` long, `{text_col}` string", id_col, text_col)
