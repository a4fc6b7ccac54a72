"""Toxicity: cumulative-link ordinal regression over sparse hashed words.

One weight vector is shared by all ordered thresholds: P(grade >= k) = sigmoid(w.x - theta_k)
with theta_1 <= theta_2 <= ..., where x is the set of a text's words (runs of letters and
digits, A-Z lower-cased), hashed to 2**BITS places. Grades are 0 (not
toxic), 1 (toxic, else of good quality) and 2 (toxic and of bad quality). The expected severity
is the sum of P(grade >= k). Weights and theta_1 are fitted to the toxic label alone, and the later
thresholds to the margins that come of it: a toxic text of good quality is no evidence against
its words. The cut of p_toxic from which a text counts as toxic is the one of best F1 over labelled
rows, each scored by a model that was fitted without its fold.

Fitting takes a bounded sample of labelled rows (SAMPLE, those of the smallest hashed ids; ties by id, then
grade), so the driver holds at most SAMPLE feature lists of at most 2**BITS places; scoring covers every document
and ships only the weights, whose size is fixed by BITS. Labels without a grade or document are not used;
a document with two labels counts with each, and so do repeated documents. Without any usable label, from an
empty table or one of nulls, no weight is set and nothing counts as toxic. Null and empty texts have no features and get the
grade that the thresholds alone give. Rows are scored each for itself, repeated or not, very long ones whole;
an empty table gives no rows. Columns besides id, text and the labels' three are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.base import U64, flat, lowered, passes, span_hashes

BITS, SAMPLE, GRADES, EVIDENCE = 18, 20_000, 3, 12.0
FOLDS = 5
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, 2**bits
    thresholds: np.ndarray  # float64, ascending, one for each grade above 0
    cut: float = 0.5  # least p_toxic of a toxic text

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -40, 40)))


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the distinct features of each row, in order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = lowered(data)
    solid = _WORD[low]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    start, end = np.flatnonzero(solid & (~before | cut[:-1])), np.flatnonzero(solid & (~after | cut[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    place = (span_hashes(low, start, end) >> U64(64 - bits)).astype(np.int64)
    both = np.unique(row << bits | place)
    return both >> bits, both & (1 << bits) - 1


def margins(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    row, place = features(data, offsets, int(np.log2(len(model.weights))))
    return np.bincount(row, model.weights[place], n)


def telling(place: np.ndarray, positive: np.ndarray, toxic: int, texts: int, size: int, least: float = EVIDENCE) -> np.ndarray:
    """Which features' log-likelihood ratio against independence of the label is `least` or more; rare words never reach it."""
    a, n = np.bincount(place[positive], minlength=size).astype(float), np.bincount(place, minlength=size).astype(float)
    cells = [(a, n * toxic / texts), (n - a, n * (1 - toxic / texts)), (toxic - a, (texts - n) * toxic / texts), (texts - toxic - n + a, (texts - n) * (1 - toxic / texts))]
    return 2 * sum(x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)) for x, e in cells) >= least


def fitted(rows: list[np.ndarray], grades: np.ndarray, bits: int = BITS, grades_n: int = GRADES, penalty: float = 5e-4, rounds: int = 200, rate: float = 0.2) -> Model:
    """Full-batch Adam, the weights and the first threshold on P(grade >= 1), each later one on its own likelihood; the rarer grades weighted up. Features without EVIDENCE stay at 0, so the weights are sparse."""
    counts = np.array([len(x) for x in rows], np.int64)
    place = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), counts)
    use = telling(place, grades[row] > 0, int((grades > 0).sum()), max(len(rows), 1), 1 << bits)[place]
    names, place = np.unique(place[use], return_inverse=True)
    row = row[use]
    above = (grades[:, None] >= np.arange(1, grades_n)[None, :]).astype(float)
    share = np.bincount(grades, minlength=grades_n)
    weight = (len(grades) / np.maximum(share, 1) ** 0.5)[grades]
    weight /= max(weight.sum(), 1e-9)
    w, gaps = np.zeros(len(names)), np.r_[0.5, np.full(grades_n - 2, np.log(1.0))]
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(gaps), np.zeros_like(gaps)]
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])])
        margin = np.bincount(row, w[place], len(rows))
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - margin[:, None], -40, 40)))
        slack = (p - above) * weight[:, None]
        gw = np.bincount(place, slack[:, 0][row], len(names)) + penalty * w
        gt = -slack.sum(0)
        gg = np.r_[gt[0], [gt[k:].sum() * np.exp(gaps[k]) for k in range(1, len(gaps))]]
        for x, g, a, b in ((w, gw, 0, 1), (gaps, gg, 2, 3)):
            state[a] = 0.9 * state[a] + 0.1 * g
            state[b] = 0.99 * state[b] + 0.01 * g * g
            x -= rate * state[a] / (1 - 0.9**t) / (np.sqrt(state[b] / (1 - 0.99**t)) + 1e-9)
    full = np.zeros(1 << bits, np.float32)
    full[names] = w
    return Model(full, np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])]))


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of highest F1, halfway to the next lower p; 1/2 where one label is missing."""
    if not toxic.any() or toxic.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(toxic[order])
    last = np.flatnonzero(np.r_[p[:-1] > p[1:], True])
    best = last[(2 * hits[last] / (last + 1 + hits[-1])).argmax()]
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0)) / 2)


def calibrated(rows: list[np.ndarray], grades: np.ndarray, bits: int = BITS, folds: int = FOLDS) -> Model:
    """The model of all rows, with the cut taken from rows held out fold by fold; rows of the same words share a fold."""
    fold = np.array([zlib.crc32(x.astype(np.int32).tobytes()) % folds for x in rows], int)
    p = np.zeros(len(rows))
    for k in range(folds):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        part = fitted([rows[i] for i in rest], grades[rest], bits)
        p[own] = part.at_least(np.array([part.weights[rows[i]].sum(dtype=float) for i in own]))[:, 0]
    return replace(fitted(rows, grades, bits), cut=best_cut(p, grades > 0))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of at most `sample` labelled rows."""
    toxic = F.col("toxic") > 0
    grade = F.when(toxic.isNull(), None).when(~toxic, 0).when(F.coalesce(F.col("quality"), F.lit(1)) > 0, 1).otherwise(2)
    few = labels.select(F.col("doc_id").cast("long").alias("__doc"), grade.alias("__grade")).where("__doc IS NOT NULL AND __grade IS NOT NULL").orderBy(F.xxhash64("__doc"), "__doc", "__grade").limit(sample)
    joined = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(few), F.col("__id") == F.col("__doc"))  # bounded by `sample`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(1))
            row, place = features(data, at, bits)
            cut = np.searchsorted(row, np.arange(len(at)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([place[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["grade", "places"])

    got = joined.select("__grade", "__text").mapInArrow(run, "grade int, places binary").collect()
    return [np.frombuffer(r.places, np.int32) for r in got], np.array([r.grade for r in got], int)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, p_toxic, p_severe, expected_severity, grade (0 if not toxic, else the likeliest above) and toxic (p_toxic >= the model's cut)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(1))
            m = np.concatenate([margins(model, data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in passes(at)] or [np.zeros(0)])
            p = model.at_least(m)
            toxic = p[:, 0] >= model.cut
            grade = np.where(toxic, 1 + (p - np.concatenate([p[:, 1:], np.zeros((len(p), 1))], 1)).argmax(1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, 0]), pa.array(p[:, -1]), pa.array(p.sum(1)), pa.array(grade.astype(np.int32)), pa.array(toxic)], [id_col, "p_toxic", "p_severe", "expected_severity", "grade", "toxic"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` long, p_toxic double, p_severe double, expected_severity double, grade int, toxic boolean")
