"""What the operators share: checkpoints, byte-level hashing of Arrow text, packed payloads.

Text reaches Python as Arrow batches. A batch's strings are one UTF-8 buffer with
offsets, so words, shingles and windows of thousands of documents are found with a
handful of numpy passes instead of a Python loop over words.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of a range up to which its hash is a polynomial mod 2**64; that has known collisions, none of them shorter than some hundred letters.
SHORT_RANGE = 32
#: Bytes of text that a numpy pass holds at once; a longer document is a pass of its own.
PASS_BYTES = 1 << 18


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the folder that spark.checkpoint.dir names; where it is unset, a temporary one in local mode only."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return df.checkpoint(eager=True)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores until no column bears it (Spark's names ignore case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys a shuffle partition, on average, that a join may set aside as hot.
HOT_KEYS = 4


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, scatter: str) -> DataFrame:
    """rows left-joined with the checkpointed table, which has one row for each key and in `weight` how many of the rows bear it.

    Keys that bear more than their share of one task are broadcast: since the weights' sum is fixed, there
    are fewer than HOT_KEYS a partition of them, at any size. Their rows are then dealt by a hash of the column
    `scatter` instead of the key, so that no task gets all of them. The other keys are joined by shuffle.
    """
    most = HOT_KEYS * partitions(rows.sparkSession)
    total = table.agg(F.sum(weight)).first()[0] or 0
    more = [c for c in table.columns if c not in keys]
    hot, cold = (table.where(f"{weight} {sign} {max(total / most, 2)}") for sign in (">", "<="))
    hot = hot.select(*[F.col(k).alias(f"hot_{k}") for k in keys], *[F.col(c).alias(f"hot_{c}") for c in more])
    cold = cold.select(*[F.col(k).alias(f"cold_{k}") for k in keys], *[F.col(c).alias(f"cold_{c}") for c in more])
    is_hot = F.col(f"hot_{weight}").isNotNull()
    marked = rows.join(F.broadcast(hot), F.expr(" AND ".join(f"{k} = hot_{k}" for k in keys)), "left")
    dealt = marked.select(*rows.columns, *[f"hot_{c}" for c in more], *[F.when(is_hot, F.xxhash64(F.lit(i), F.col(scatter))).otherwise(F.col(k)).alias(f"dealt_{k}") for i, k in enumerate(keys)])
    both = dealt.join(cold, F.expr(" AND ".join([*(f"dealt_{k} = cold_{k}" for k in keys), f"hot_{weight} IS NULL"])), "left")
    return both.select(*rows.columns, *[F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in more])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text under fixed names, so that no other column's name can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def passes(offsets: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, never splitting a row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# --- hashing -----------------------------------------------------------------------------

_rng = np.random.RandomState(20240229)
_FULL = lambda n: _rng.randint(0, 2**32, n, dtype=np.uint64) << U64(32) | _rng.randint(0, 2**32, n, dtype=np.uint64)
_TABLES = [_FULL(256), _FULL(256)]
_BASES = [int(x) | 1 for x in _FULL(2)]
_SEQ_BASES = [int(x) | 1 for x in _FULL(2)]
_GRAM = _FULL(64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        with np.errstate(over="ignore"):
            while len(have) < n:
                have = np.concatenate([have, have * U64(pow(base, len(have), 2**64))])
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def _spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * powers(pow(base, -1, 2**64), len(prefix))[start]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range; the two lanes differ in tables and base. Ranges beyond SHORT_RANGE bytes are hashed by xxh3."""
    with np.errstate(over="ignore"):
        out = mix(_spans(_prefix(_TABLES[lane][data], _BASES[lane]), start, end, _BASES[lane]) + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))
    far = np.flatnonzero(end - start > SHORT_RANGE)
    if len(far):
        raw = memoryview(np.ascontiguousarray(data))
        out[far] = [xxhash.xxh3_64_intdigest(raw[a:b], lane) for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)]
    return out


def byte_windows(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width` bytes, a few dozen at most; one for each start that leaves room."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    start = np.arange(n)
    return mix(_spans(_prefix(_TABLES[0][data], _BASES[0]), start, start + width, _BASES[0]))


def sequence_windows(words: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each `width` consecutive word hashes, a few dozen at most; it proposes, and the words decide."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    start = np.arange(n)
    return mix(_spans(_prefix(words, _SEQ_BASES[lane]), start, start + width, _SEQ_BASES[lane]))


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One hash of a whole sequence of any length."""
    return np.array([xxhash.xxh3_64_intdigest(np.ascontiguousarray(words).tobytes())], U64)


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of short runs of words: a weighted sum, cheaper than prefix sums for a few words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = words[:n] * _GRAM[0]
        for k in range(1, width):
            out += words[k : n + k] * _GRAM[k]
    return mix(out)


# --- words -------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    start = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def plain_words(text: bytes) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text: bytes are split at just these six."""
    return text.split()


# --- payloads ----------------------------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """An array's bytes by significance, compressed: the high bytes of small or sorted-and-differenced numbers cost nothing."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unplaned(blob: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(blob[8:], n, "zstd", asbytes=True), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def packed(*arrays: np.ndarray) -> bytes:
    """Several arrays in one value."""
    parts = [planes(x) for x in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(unplaned(blob[at + 8 : at + 8 + n], kind))
        at += 8 + n
    return out


def steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first value kept."""
    return np.diff(ordered, prepend=ordered.dtype.type(0)) if len(ordered) else ordered


def unsteps(differences: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(differences, dtype=differences.dtype)
