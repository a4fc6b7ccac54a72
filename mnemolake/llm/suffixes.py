"""Suffix-array dedup: a common-prefix-aware distributed merge sort of suffixes.

A byte is removed if a string of LENGTH (200) bytes that covers it also starts anywhere else.
Of every 200-byte string, the places where the hash of KEY (24) bytes is least are its anchors:
they depend on its content alone, so copies have the same anchors. Only anchors whose key is met
twice are sorted. Each task sorts the suffixes (up to 200 bytes from the anchor) of some thousand
documents and front-codes the run: the length of the prefix shared with the suffix before, and the rest.
Runs are exchanged by key bucket and merged by a loser tree that keeps, for every waiting run, how
many bytes it shares with the last winner; two suffixes are compared only beyond what they are
known to share, and the merge yields the common prefixes of neighbours for free. A bucket is
some megabytes, however large the corpus; a partition merges its buckets one after the other.

With a suffix travel the up to 176 bytes before its anchor. A pair of anchors that share L bytes to
the left and R to the right is one maximal run of L + R bytes around the anchor; it counts if
L + R >= 200, and then covers all of it. Pairs are compared directly; in larger groups of one
key, anchors are classed, for every offset o, by their o bytes to the left and 200 - o to the
right, so a passage in many documents costs time in proportion to them, not to their pairs.
All comparisons are of bytes; hashes only choose candidates. Anchors alike in all that travels, as in a
passage that many documents hold or a text of one letter, are one entry of a run and settled where they meet.

Null and empty texts have no bytes. Documents shorter than 200 bytes lose nothing. Rows alike in id
and text are copies of each other as any. Matches never cross documents. A very long text is read whole by
one worker. Which of equal rows comes first does not matter, nor do columns besides id and
text, which are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from mnemolake.llm import anchors
from mnemolake.llm.base import U64, byte_windows, flat, mix, packed, passes, unpacked

LENGTH, KEY = 200, 24
#: Keys in a string of LENGTH bytes, and the most bytes that it can have before an anchor.
WIDE = LENGTH - KEY + 1
BEFORE = LENGTH - KEY
I64, I32, U32, U8 = np.int64, np.int32, np.uint32, np.uint8
#: Different suffixes that a task sorts into a run.
ITEMS = 60_000
ITEM = "suffix binary, before binary, uid long, g int, place int, many boolean"


def _sliding(x: np.ndarray, wide: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over x[i : i + wide] for each i, by prefix and suffix passes over blocks."""
    n = len(x)
    padded = np.full(-(-(n + wide) // wide) * wide, fill, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, wide)
    ahead = pick.accumulate(rows, axis=1).ravel()
    behind = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[wide - 1 : wide - 1 + n])


def anchor_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of all anchors, and the hashes of their keys."""
    if len(data) < LENGTH:
        return np.zeros(0, I64), np.zeros(0, U64)
    h = np.full(len(data), U64(2**64 - 1))
    own = byte_windows(data, KEY)
    h[: len(own)] = np.maximum(own, U64(1))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    left = ends - np.arange(len(data))
    h[left < KEY] = U64(2**64 - 1)
    least = _sliding(h, WIDE, np.minimum, 2**64 - 1)
    least[left < LENGTH] = U64(0)  # no string starts here
    back = np.zeros(len(data), U64)
    shifted = np.concatenate([np.zeros(WIDE - 1, U64), least])
    back[:] = _sliding(shifted, WIDE, np.maximum, 0)[: len(data)]
    # strings that start before the document do not reach into it: least is 0 near the end of the one before
    at = np.flatnonzero((back == h) & (left >= KEY))
    return at, h[at]


def _anchored(buckets: int, bits: int):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            uids, groups = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, at = flat(batch.column(1))
            for i, j in passes(at):
                off = at[i : j + 1] - at[i]
                p, h = anchor_places(data[at[i] : at[j]], off)
                row = np.searchsorted(off, p, "right") - 1
                # least hashes lie close together: mixed, they fill all buckets alike
                yield mix(h), groups[i:j][row], uids[i:j][row], p - off[row], np.zeros(0, U64)

    return lambda batches: anchors.flushes(parts(batches), buckets, bits)


# --- front-coded runs ---


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that `known` bytes agree."""
    most = min(len(a), len(b))
    h = known
    while h < most and a[h : h + 32] == b[h : h + 32]:
        h += 32
    if h >= most:
        return most
    x = int.from_bytes(a[h : h + 32].ljust(32, b"\0"), "big") ^ int.from_bytes(b[h : h + 32].ljust(32, b"\0"), "big")
    return min(most, h + (256 - x.bit_length()) // 8) if x else most


def coded(items: list[tuple[bytes, bytes, int, int, int, int]]) -> bytes:
    """A run of (suffix, bytes before reversed, many, uid, g, place), sorted, front-coded."""
    n = len(items)
    shared, tails, last = np.zeros(n, U8), [], b""
    for i, x in enumerate(items):
        k = common(last, x[0])
        shared[i] = k
        tails.append(x[0][k:])
        last = x[0]
    many, uid, g, place = (np.array(x, kind) for x, kind in zip(list(zip(*items, strict=True))[2:], (U8, I64, I32, I32), strict=True))
    tail_n = np.fromiter(map(len, tails), U8, n)
    before_n = np.fromiter((len(x[1]) for x in items), U8, n)
    text = np.frombuffer(pa.compress(b"".join([*tails, *(x[1] for x in items)]), "zstd", asbytes=True), U8)
    size = np.array([int(tail_n.sum(dtype=I64)) + int(before_n.sum(dtype=I64))], I64)
    return packed(shared, tail_n, before_n, many, uid, g, place, size, text)


class Run:
    """Reads a coded run: the suffixes one by one, each with what it shares with the one before."""

    def __init__(self, blob: bytes) -> None:
        self.shared, self.tail_n, before_n, self.many, self.uid, self.g, self.place, size, text = unpacked(blob, U8, U8, U8, U8, I64, I32, I32, I64, U8)
        raw = pa.decompress(text.tobytes(), int(size[0]), "zstd", asbytes=True)
        ends = np.concatenate([self.tail_n, before_n]).astype(I64).cumsum().tolist()
        n = len(self.shared)
        starts = [0, *ends]
        self.tails = [raw[a:b] for a, b in zip(starts[:n], ends[:n], strict=True)]
        self.before = [raw[a:b] for a, b in zip(starts[n : 2 * n], ends[n:], strict=True)]
        self.shared = self.shared.tolist()
        self.at, self.now = -1, b""

    def advance(self) -> bool:
        self.at += 1
        if self.at >= len(self.tails):
            return False
        self.now = self.now[: self.shared[self.at]] + self.tails[self.at]
        return True


def merged(runs: list[Run]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, item, suffix, bytes shared with the suffix yielded before), in order, by a loser tree.

    Each inner node keeps the loser of its game with the length it shares with the winner. After
    the winner's run has moved on, only its path is replayed, and of two suffixes that share
    different lengths with the last winner, the one that shares more is less: no byte is read.
    """
    runs = [r for r in runs if r.advance()]
    size = 1
    while size < len(runs):
        size *= 2
    live = [True] * len(runs) + [False] * (size - len(runs))
    lcp = [0] * size
    tree = [-1] * (2 * size)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs whose lcp is with the same suffix."""
        if not live[b]:
            return a, b
        if not live[a]:
            return b, a
        la, lb = lcp[a], lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        x, y = runs[a].now, runs[b].now
        k = common(x, y, la)
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            lcp[b] = k
            return a, b
        lcp[a] = k
        return b, a

    winners = [-1] * (2 * size)
    for i in range(size):
        winners[size + i] = i
    for node in range(size - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while live[best]:
        run = runs[best]
        yield best, run.at, run.now, lcp[best]
        if run.advance():
            lcp[best] = run.shared[run.at]
        else:
            live[best] = False
        node = (size + best) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2


# --- from sorted suffixes to covered bytes ---


def _matrix(strings: list[bytes], wide: int) -> np.ndarray:
    return np.frombuffer(b"".join([s.ljust(wide, b"\0") for s in strings]), U8).reshape(-1, wide)


def _agree(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix lengths of the rows of two matrices, `most` at most."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return np.minimum(first, most)


def covered(suffix_n: np.ndarray, shared: np.ndarray, before: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted suffixes: (item, bytes to the left, bytes to the right) of what repeated strings cover around the anchors."""
    n = len(suffix_n)
    head = shared < KEY
    head[:1] = True
    group = np.cumsum(head) - 1
    sizes = np.bincount(group, minlength=1)
    firsts = np.flatnonzero(head)
    left_n = np.fromiter(map(len, before), I64, n)
    items, lefts, rights = [], [], []
    two = firsts[sizes == 2]
    for k in range(0, len(two), 20_000):
        a = two[k : k + 20_000]
        b = a + 1
        l = _agree(_matrix([before[i] for i in a], BEFORE), _matrix([before[i] for i in b], BEFORE), np.minimum(left_n[a], left_n[b]))
        r = shared[b]
        ok = l + r >= LENGTH
        for side in (a, b):
            items.append(side[ok])
            lefts.append(l[ok])
            rights.append(r[ok])
    many = np.flatnonzero(sizes[group] > 2)
    if len(many):
        m = len(many)
        suffix, common_, n_left = suffix_n[many], shared[many].copy(), left_n[many]
        common_[head[many]] = 0
        strings = [before[i] for i in many]
        order = np.array(sorted(range(m), key=strings.__getitem__), I64)
        lcs = np.zeros(m, I64)
        for k in range(1, m, 20_000):
            at = np.arange(k, min(k + 20_000, m))
            lcs[at] = _agree(_matrix([strings[i] for i in order[at - 1]], BEFORE), _matrix([strings[i] for i in order[at]], BEFORE), np.minimum(n_left[order[at - 1]], n_left[order[at]]))
        low, high = np.full(m, LENGTH), np.full(m, -1)
        left_class = np.zeros(m, I64)
        for o in range(BEFORE + 1):
            fits = (suffix >= LENGTH - o) & (n_left >= o)
            right_class = np.cumsum(common_ < LENGTH - o)
            left_class[order] = np.cumsum(lcs < o)
            at = np.flatnonzero(fits)
            key = right_class[at] * (m + 1) + left_class[at]
            put = np.argsort(key, kind="stable")
            key = key[put]
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            hit = at[put[same[1:] | same[:-1]]]
            low[hit] = np.minimum(low[hit], o)
            high[hit] = o
        got = high >= 0
        items.append(many[got])
        lefts.append(high[got])
        rights.append(LENGTH - low[got])
    whole = lambda x: np.concatenate(x).astype(I64) if x else np.zeros(0, I64)
    return whole(items), whole(lefts), whole(rights)


class Suffixes:
    """Gathers suffixes with what stands before them; of those alike in both, one is kept and the places of all."""

    def __init__(self) -> None:
        self.kept: dict[tuple[bytes, bytes], list] = {}  # -> [many, places (uid, g, place) in a row]
        self.size = 0

    def add(self, suffix: bytes, before: bytes, uid: int, g: int, place: int, many: bool = False) -> None:
        found = self.kept.get((suffix, before))
        if found is None:
            found = self.kept[suffix, before] = [False, array("q")]
        found[0] = found[0] or many
        found[1].extend((uid, g, place))
        self.size += 1

    def settled(self) -> tuple[list[tuple[bytes, bytes, int, int, int, int]], np.ndarray]:
        """(suffix, before, many, uid, g, place) of each different one, and rows (g, uid, start, end) of what is covered already: all that travels of two alike, if it is long enough."""
        left, done = [], [np.zeros((0, 4), I64)]
        for (suffix, before), (many, where) in self.kept.items():
            own = np.frombuffer(where, I64).reshape(-1, 3)
            twice = many or len(own) > 1
            if twice and len(suffix) + len(before) >= LENGTH:
                done.append(np.column_stack([own[:, 1], own[:, 0], own[:, 2] - len(before), own[:, 2] + len(suffix)]))
                own = own[:1]
            else:  # too short a text: none of them is covered by being alike
                twice = False
            left += [(suffix, before, int(twice), *map(int, x)) for x in own]
        return left, np.concatenate(done)


def _ranges(rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    g, uid, start, end = rows.T
    return anchors.by_group(g, uid, start, end)


def _suffixes(docs: pa.Table, hits: pa.Table) -> pa.Table:
    """The suffixes of a group at its anchors that are met elsewhere."""
    uid, pos = anchors.places(hits["blob"].to_pylist())
    held, g = Suffixes(), docs["g"][0].as_py() if len(docs) else 0
    for u, text in zip(*anchors.texts(docs), strict=True) if len(uid) else ():
        a, b = np.searchsorted(uid, u), np.searchsorted(uid, u, "right")
        for p in np.unique(pos[a:b]).tolist():
            held.add(text[p : p + LENGTH], text[max(0, p - BEFORE) : p][::-1], int(u), g, p)
    left, done = held.settled()
    rows = [(s, x, u, h, p, bool(many)) for s, x, many, u, h, p in left]
    rows += [(None, blob, 0, g, 0, False) for g, blob in _ranges(done)]  # without a suffix: ranges that are settled
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], ["suffix", "before", "uid", "g", "place", "many"])


def _runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Suffixes()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] is None:
                    yield anchors.sent(anchors.passed([(row[3], row[1])], buckets))
                else:
                    held.add(*row)
            if len(held.kept) >= ITEMS or held.size >= 20 * ITEMS:
                yield _sorted(held, buckets)
                held = Suffixes()
        if held.kept:
            yield _sorted(held, buckets)

    return run


def _sorted(held: Suffixes, buckets: int) -> pa.RecordBatch:
    left, done = held.settled()
    rows = anchors.passed(_ranges(done), buckets)
    by: dict[int, list] = defaultdict(list)
    for x in left:
        by[xxhash.xxh3_64_intdigest(x[0][:KEY]) * buckets >> 64].append(x)
    for bucket, items in by.items():
        items.sort()
        rows.append((bucket, 0, -1, coded(items)))
    return anchors.sent(rows)


def _merge(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Byte ranges that a bucket's runs cover, as payloads by group."""
    runs = [Run(blob) for blob in blobs]
    number, item, length, shared = [], [], [], []
    for r, i, suffix, k in merged(runs):
        number.append(r)
        item.append(i)
        length.append(len(suffix))
        shared.append(k)
    before = [runs[r].before[i] for r, i in zip(number, item, strict=True)]
    uid, g, place = (np.array([getattr(runs[r], name)[i] for r, i in zip(number, item, strict=True)], I64) for name in ("uid", "g", "place"))
    at, left, right = covered(np.array(length, I64), np.array(shared, I64), before)
    yield from anchors.by_group(g[at], uid[at], place[at] - left, place[at] + right)


def repeats(docs: DataFrame, deal: anchors.Deal) -> DataFrame:
    """(g, blob): byte ranges covered by strings that start anywhere else."""
    hits = anchors.repeated(docs.select("uid", "text", "g").mapInArrow(_anchored(deal.buckets, anchors.hash_bits(deal.bytes / 50)), anchors.SENT))
    # with all columns each time, so that the texts are exchanged once
    suffixes = docs.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(_suffixes, ITEM)
    return anchors.dealt(suffixes.mapInArrow(_runs(deal.buckets), anchors.SENT), _merge)


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of the text, bytes removed, maximal removed runs."""
    parts, at, spans, removed = [], 0, 0, 0
    open_to = -1
    for a, b in sorted(ranges):
        if a > open_to:
            parts.append(text[at:a])
            spans += 1
            removed += b - a
            open_to = b
        elif b > open_to:
            removed += b - open_to
            open_to = b
        at = open_to
    return b"".join([*parts, text[at:]]), removed, spans


def _removed(docs: DataFrame, finish, schema: str, id_col: str, text_col: str) -> DataFrame:
    light, deal = anchors.grouped(docs, id_col, text_col)

    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        uid, start, end = anchors.places(flags["blob"].to_pylist(), 2)
        out = []
        for u, text in zip(*anchors.texts(texts), strict=True):
            a, b = np.searchsorted(uid, u), np.searchsorted(uid, u, "right")
            out.append((len(text), *_cut(text, list(zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)))))
        return pa.Table.from_batches([finish(texts["doc_id"].combine_chunks(), out)])

    return light.groupBy("g").cogroup(repeats(light, deal).groupBy("g")).applyInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_bytes, n_removed, n_spans and kept_sha256."""

    def finish(ids, rows):  # noqa: ANN001, ANN202
        column = lambda k: pa.array([x[k] for x in rows], pa.int64())
        return pa.RecordBatch.from_arrays([ids, column(0), column(2), column(3), pa.array([hashlib.sha256(x[1]).hexdigest() for x in rows], pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _removed(docs, finish, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bytes): what is left of each text; cuts may fall inside a character, so the rest is bytes."""

    def finish(ids, rows):  # noqa: ANN001, ANN202
        return pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in rows], pa.binary())], [id_col, text_col])

    return _removed(docs, finish, f"`{id_col}` long, `{text_col}` binary", id_col, text_col)
