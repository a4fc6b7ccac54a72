"""Document fingerprints by I-Match: terms within an inverse-document-frequency band, distinct and sorted, hashed over several randomised lexicon subsets.

The lexicon holds the terms (words, A-Z lower-cased, ASCII punctuation stripped at both ends)
whose share of documents lies between LEAST_SHARE and MOST_SHARE: a band of idf = -ln(share).
Document frequencies are counted over all documents, summed per task before the shuffle. Since a
document has on average T distinct terms, at most T / LEAST_SHARE terms can reach the lower share, however
many documents there are; that proven bound (8 bytes a term: 4 MB for texts of 1,000 distinct
terms) is why the lexicon may be sent to every task.

A fingerprint has one part for each subset of the lexicon. The last subset is the whole lexicon; each
other keeps a term by a hash of (subset, term), at RATES[subset % len(RATES)]. A part is a hash of the sequence of the
document's distinct terms that the subset keeps, sorted by their 64-bit hashes, and `-` if none is kept.
Small subsets meet few of a document's terms and survive edits, large ones tell documents apart. `likeness` is
the share of equal parts among those that either has; without such parts it is 1 for equal
texts and else 0.

Equal texts have equal fingerprints, repeated rows too. Null counts as the empty text; a text without a term of
the lexicon has the fingerprint of dashes only. The next document is that of the next higher (doc_id, text), after
the last the first; of rows with equal id and text either may be first, which gives the same rows. The
only document is its own next, and so is a row without doc_id, which has no place in the order. Documents are
range-partitioned by id and each range also gets the head of the next, so the neighbour is there without a
global sort in one task. A very long text is read whole by one worker, with about a million
characters of its neighbours. An empty table gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.base import U64, flat, lowered, mix, partitions, passes, span_hashes, word_spans

LEAST_SHARE, MOST_SHARE = 2e-3, 0.2
SUBSETS, RATES = 25, (1 / 192, 1 / 96, 1 / 48, 1 / 24)
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SALTS = mix(np.arange(1, SUBSETS + 1, dtype=U64))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's distinct terms, by row and then by hash."""
    low = lowered(data)
    start, end, first = word_spans(low, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    for side in (0, 1):  # strip marks
        while True:
            at = np.flatnonzero((start < end) & _MARK[low[np.minimum(start, len(low) - 1) if not side else end - 1]]) if len(start) else start
            if not len(at):
                break
            if side:
                end[at] -= 1
            else:
                start[at] += 1
    full = start < end
    h = span_hashes(low, start[full], end[full])
    order = np.lexsort((h, row[full]))
    h, row = h[order], row[full][order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms in the band; its size is bounded by T / least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, n = np.concatenate(held), np.concatenate(counts)
            u, at = np.unique(h, return_inverse=True)
            return u, np.bincount(at, n, len(u)).astype(np.int64)

        size = 0
        for batch in batches:
            data, at = flat(batch.column(0))
            for i, j in passes(at):
                u, n = np.unique(terms(data[at[i] : at[j]], at[i : j + 1] - at[i])[0], return_counts=True)
                held.append(u)
                counts.append(n)
                size += len(u)
                if size > 1_000_000:
                    u, n = summed()
                    if len(u) > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["term", "n"])
                        held, counts, size = [], [], 0
                    else:
                        held, counts, size = [u], [n], len(u)
        if held:
            u, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["term", "n"])

    light = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    total = light.select(F.count(F.lit(1))).first()[0]
    counted = light.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where((F.col("n") >= max(2, least * total)) & (F.col("n") <= most * total))
    return np.sort(counted.select("term").toArrow()["term"].to_numpy().view(U64))


def subset_keeps(s: int, h: np.ndarray) -> np.ndarray:
    """Which terms a subset keeps."""
    if s == SUBSETS - 1:
        return np.ones(len(h), bool)
    return mix(h ^ _SALTS[s]) < U64(int(RATES[s % len(RATES)] * 2**64))


def parts(h: np.ndarray, row: np.ndarray, rows: int, band: np.ndarray) -> np.ndarray:
    """(rows, SUBSETS) hashes of the terms kept, in their order; 0 where a subset keeps none. h is sorted within each row."""
    out = np.zeros((rows, SUBSETS), U64)
    if not len(band) or not len(h):
        return out
    use = band[np.minimum(np.searchsorted(band, h), len(band) - 1)] == h
    h, row = h[use], row[use]
    for s in range(SUBSETS):
        use = subset_keeps(s, h)
        kept, of = memoryview(h[use].tobytes()), row[use]
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        ends = [*(8 * cut[1:]).tolist(), len(kept)]
        out[of[cut], s] = [xxhash.xxh3_64_intdigest(kept[a:b]) or 1 for a, b in zip((8 * cut).tolist(), ends, strict=False)]
    return out


def spelt(part: np.ndarray) -> str:
    return ".".join(f"{int(x):016x}" if x else "-" for x in part)


def likeness(a: np.ndarray, b: np.ndarray, same: bool = False) -> float:
    some = (a != 0) | (b != 0)
    return float(((a == b) & some).sum() / some.sum()) if some.any() else float(same)


def edited(text: str, after: str) -> str:
    """The last half of the text replaced by as many first code points of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _fingerprints(texts: list[str], band: np.ndarray) -> np.ndarray:
    data, at = flat(pa.array(texts, pa.large_string()))
    got = [parts(*terms(data[at[i] : at[j]], at[i : j + 1] - at[i]), j - i, band) for i, j in passes(at)]
    return np.concatenate(got) if got else np.zeros((0, SUBSETS), U64)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, extra, doc_id, text), ranged: sorted within each place; rows with extra = 1 are the heads of the place after, with 2 those without an id."""
    light = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = partitions(docs.sparkSession)
    cuts = sorted({int(x) for x in light.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    # the number of cuts up to the id, by halving
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]) if cuts else F.array().cast("array<int>")
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    rank = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)) if cuts else F.lit(0)
    place = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).otherwise(rank)
    # one row a place: as many as there are partitions
    heads = dict(light.where("doc_id IS NOT NULL").select(rank.alias("place"), "doc_id").groupBy("place").agg(F.min("doc_id")).collect())
    some = sorted(heads)
    before = {p: some[k - 1] for k, p in enumerate(some)}
    listed = lambda d, t: F.array(*[F.lit(d.get(p)).cast(t) for p in range(n)])
    own = F.struct(place.alias("place"), F.when(F.col("doc_id").isNull(), 2).otherwise(0).alias("extra"))
    copy = F.struct(F.get(listed(before, "int"), rank).alias("place"), F.lit(1).alias("extra"))
    is_head = F.get(listed(heads, "long"), rank) == F.col("doc_id")
    rows = light.select("doc_id", "text", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("at"))
    return rows.select("at.place", "at.extra", "doc_id", "text").repartitionById(n, F.col("place")).sortWithinPartitions("place", "extra", "doc_id", "text")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """One row for each document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    band = lexicon(docs, text_col, least, most)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Blocks of consecutive rows of about a million characters."""
        block, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.append(row)
                size += len(row[3])
                if size > 1_000_000:
                    yield block
                    block, size = [], 0
        if block:
            yield block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row still waiting for its next
        for block in rows(batches):
            whole = ([last] if last else []) + block
            own = _fingerprints([r[3] for r in whole], band)
            # (row, its next): a row without an id is its own; one that was the last of its block waits
            pairs = [i for i in range(len(whole) - 1) if not whole[i][1] and whole[i][0] == whole[i + 1][0] and whole[i + 1][1] < 2]
            after = {i: i + 1 for i in pairs} | {i: i for i in range(1 if last else 0, len(whole)) if whole[i][1] == 2}
            pairs = list(after)
            changed = [edited(whole[i][3], whole[j][3]) for i, j in after.items()]
            new = _fingerprints(changed, band)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([whole[i][2] for i in pairs], pa.int64()),
                    pa.array([len(whole[i][3]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([spelt(own[i]) for i in pairs], pa.string()),
                    pa.array([spelt(x) for x in new], pa.string()),
                    pa.array([likeness(own[i], x, whole[i][3] == t) for i, x, t in zip(pairs, new, changed, strict=True)], pa.float64()),
                    pa.array([likeness(own[i], own[j], whole[i][3] == whole[j][3]) for i, j in after.items()], pa.float64()),
                ],
                names,
            )
            last = whole[-1]

    return with_next(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
