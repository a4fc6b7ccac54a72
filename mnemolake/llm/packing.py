"""Conflict-constrained best-fit packing into bins of a fixed number of words.

No bin holds two pieces of one source or of one duplicate cluster. Bins are kept by residual;
each residual's bins are kept by their source bitmap. The successor search starts at the
tightest residual that fits and goes up, past every bin whose source or cluster bitmap holds
the piece's bit, until a compatible bin is found, so the bin chosen is the tightest compatible one;
if there is none, a new bin is opened. Pieces are placed longest first; ties by id, then start.

A document longer than a bin is cut at word boundaries into full pieces, each a bin of its own,
and a remainder. Documents without words (null or empty texts) take no space: their bin_id is
null. A null source conflicts with nothing. A cluster is the documents with one sequence of
words, A-Z lower-cased (128 bits of a hash over all of it). Rows with equal ids are packed as separate
documents, repeated rows too. An empty table gives no rows; columns besides id, text and source are not read.

No task holds more than about `group` pieces. Documents are dealt by a hash of id, text and place to
groups, packed each in a task of its own: two pieces that could conflict in different groups are in
different bins anyway, and neither a hot source nor a hot cluster decides where a row goes. Then the search
crosses groups: bins of all groups with `room` words left or more are packed again as pieces that
carry the sources and clusters of all they hold, in rounds of newly dealt groups, until one group
holds all such bins or a round no longer makes them fewer (as where one source has very many
documents, of which a bin takes one). Only ids and counts are shuffled, never texts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.base import checkpointed, plain_words

CAPACITY, GROUP = 2048, 20_000
#: Words left from which a bin is packed again with those of other groups; the least share of such bins that a round must do away with.
ROOM, LESS = CAPACITY // 8, 0.02


class Bins:
    """Open bins by residual and source bitmap."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.by: dict[int, dict[int, list[int]]] = {}
        self.residuals: list[int] = []  # sorted keys of `by`
        self.clusters: list[int] = []  # bitmap of each bin
        self.opened = 0

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin that takes a piece; source and cluster are bitmaps with one bit, or 0 for none."""
        i = bisect_left(self.residuals, size)
        while i < len(self.residuals):
            left = self.residuals[i]
            masks = self.by[left]
            for mask, bins in masks.items():
                if not mask & source:
                    at = next((k for k in range(len(bins)) if not self.clusters[bins[k]] & cluster), None)
                    if at is not None:
                        found = bins[at]
                        bins[at] = bins[-1]
                        bins.pop()
                        if not bins:
                            del masks[mask]
                            if not masks:
                                del self.by[left]
                                self.residuals.pop(i)
                        self._put(found, left - size, mask | source, cluster)
                        return found
            i += 1
        self.clusters.append(0)
        self.opened += 1
        self._put(self.opened - 1, self.capacity - size, source, cluster)
        return self.opened - 1

    def _put(self, bin_no: int, left: int, mask: int, cluster: int) -> None:
        self.clusters[bin_no] |= cluster
        if left <= 0:
            return
        masks = self.by.get(left)
        if masks is None:
            masks = self.by[left] = {}
            self.residuals.insert(bisect_left(self.residuals, left), left)
        masks.setdefault(mask, []).append(bin_no)


class Bits(dict):
    """A bit for each name that a group meets."""

    def mask(self, names) -> int:  # noqa: ANN001
        return sum({1 << self.setdefault(x, len(self)) for x in names})


def ordered(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Documents in the order in which their remainders are placed."""
    return rows.assign(rest=rows.n_words % capacity).sort_values(["rest", "doc_id", "n_words", "cluster", "at"], ascending=[False, True, True, True, True], kind="stable", na_position="last")


def packed_group(rows: pd.DataFrame, capacity: int = CAPACITY, room: int = ROOM) -> pd.DataFrame:
    """Bins for one group of (group, at, doc_id, source, cluster, n_words): a row for each piece, and a row without `piece` for each bin with room, with what it holds."""
    bins, sources, clusters = Bins(capacity), Bits(), Bits()
    twins = rows.cluster[rows.cluster.duplicated(keep=False)]
    twins = set(twins)
    pieces: list[tuple] = []
    held: dict[int, list] = {}
    later = []
    order = ordered(rows, capacity)
    for doc, source, cluster, n, rest in zip(order.doc_id, order.source, order.cluster, order.n_words, order.rest, strict=True):
        known = isinstance(source, str)
        later += [(doc, k, k * capacity, capacity) for k in range(n // capacity)]
        if rest:
            at = bins.place(int(rest), sources.mask([source] if known else []), clusters.mask([cluster] if cluster in twins else []))
            pieces.append((at, doc, n // capacity, n - rest, rest, None, None))
            mine = held.setdefault(at, [0, [], []])
            mine[0] += int(rest)
            mine[1] += [source] if known else []
            mine[2].append(cluster)
    pieces += [(bins.opened + i, *x, None, None) for i, x in enumerate(later)]
    pieces += [(at, None, None, None, used, own, twin) for at, (used, own, twin) in held.items() if capacity - used >= room]
    got = pd.DataFrame(pieces, columns=["bin_id", "doc_id", "piece", "start", "n_words", "sources", "clusters"])
    got["bin_id"] = (int(rows.group.iloc[0]) << 32) + got.bin_id
    return got.astype({c: "Int64" for c in ("bin_id", "doc_id", "piece", "start", "n_words")})


def joined_group(rows: pd.DataFrame, capacity: int = CAPACITY, room: int = ROOM) -> pd.DataFrame:
    """(bin_id, to) for the bins of one group, each packed as one piece, and a row without bin_id for each `to` that still has room."""
    bins, sources, clusters = Bins(capacity), Bits(), Bits()
    names: list[int] = []
    held: list[list] = []
    out = []
    order = rows.sort_values(["n_words", "to"], ascending=[False, True])
    for to, used, own, twin in zip(order.to, order.n_words, order.sources, order.clusters, strict=True):
        at = bins.place(int(used), sources.mask(own), clusters.mask(twin))
        if at == len(names):
            names.append(int(to))
            held.append([0, [], []])
        held[at][0] += int(used)
        held[at][1] += list(own)
        held[at][2] += list(twin)
        if names[at] != to:
            out.append((int(to), names[at], None, None, None))
    out += [(None, name, *x) for name, x in zip(names, held, strict=True) if capacity - x[0] >= room]
    return pd.DataFrame(out, columns=["bin_id", "to", "n_words", "sources", "clusters"]).astype({c: "Int64" for c in ("bin_id", "to", "n_words")})


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, key, n_words, cluster) of each document; key is a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, clusters = [], []
            for text in batch.column(3).cast(pa.binary()):
                words = plain_words(text.as_buffer().to_pybytes().lower())
                counts.append(len(words))
                clusters.append(xxhash.xxh3_128_digest(b" ".join(words)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(clusters, pa.binary())], ["doc_id", "source", "key", "n_words", "cluster"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    light = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), text.alias("text"))
    return light.mapInArrow(run, "doc_id long, source string, key long, n_words long, cluster binary")


def _renamed(bins: DataFrame, group: int, capacity: int, room: int) -> DataFrame | None:
    """(bin_id, to): the bins that other groups' bins took in, over all rounds; None if there are none. bins: (to, n_words, sources, clusters)."""
    moved, n, turn = None, bins.count(), 0
    while n > 1:
        turn += 1
        groups = -(-n // group)
        dealt = bins.withColumn("group", F.pmod(F.xxhash64("to", F.lit(turn)), F.lit(groups)))
        now = checkpointed(dealt.groupBy("group").applyInPandas(lambda rows: joined_group(rows, capacity, room), "bin_id long, to long, n_words long, sources array<string>, clusters array<binary>"))
        step = now.where("bin_id IS NOT NULL").select("bin_id", "to")
        if moved is None:
            moved = step
        else:
            again = step.select(F.col("bin_id").alias("mid"), F.col("to").alias("last"))
            moved = checkpointed(moved.join(again, F.col("to") == F.col("mid"), "left").select("bin_id", F.coalesce("last", "to").alias("to")).unionByName(step))
        bins = now.where("bin_id IS NULL").select("to", "n_words", "sources", "clusters")
        left = bins.count()
        if groups == 1 or left > (1 - LESS) * n:
            break
        n = left
    return moved


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, group: int = GROUP, room: int | None = None) -> DataFrame:
    """One row for each piece: bin_id, doc_id, piece, start (a word's number) and n_words."""
    room = max(1, capacity * ROOM // CAPACITY) if room is None else room
    rows = checkpointed(measured(docs, id_col, text_col, source_col)).withColumn("at", F.monotonically_increasing_id())
    groups = max(1, -(-rows.count() // group))
    dealt = rows.where("n_words > 0").withColumn("group", F.pmod(F.xxhash64("key", "at"), F.lit(groups))).drop("key")
    wide = "bin_id long, doc_id long, piece long, start long, n_words long, sources array<string>, clusters array<binary>"
    pieces = dealt.groupBy("group").applyInPandas(lambda rows: packed_group(rows, capacity, room if groups > 1 else capacity + 1), wide)
    names = ["bin_id", "doc_id", "piece", "start", "n_words"]
    none = rows.where("n_words = 0").select(F.lit(None).cast("long").alias("bin_id"), "doc_id", *[F.lit(0).cast("long").alias(c) for c in names[2:]])
    if groups > 1:
        pieces = checkpointed(pieces)
        moved = _renamed(pieces.where("piece IS NULL").select(F.col("bin_id").alias("to"), "n_words", "sources", "clusters"), group, capacity, room)
        pieces = pieces.where("piece IS NOT NULL")
        if moved is not None:
            moved = moved.select(F.col("bin_id").alias("old"), "to")
            pieces = pieces.join(moved, F.col("bin_id") == F.col("old"), "left").withColumn("bin_id", F.coalesce("to", "bin_id"))
    return pieces.select(*names).unionByName(none)
