"""Near-dedup by circulant MinHash: two permutations, one shifted circularly, give every signature coordinate; banding; exact Jaccard.

A document's set holds its distinct five-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z
lower-cased); with fewer words the whole sequence is the one shingle; without
words the set is empty and linked with nothing. Coordinate k of a signature is the least
pi(sigma(x) shifted circularly by k) over the set. The domain has 2**52 points (i, h), i of SPACE_BITS
and h of 32 bits: sigma deals a shingle's 64-bit hash to a point, the shift adds k to i mod 2**SPACE_BITS,
and pi(i, h) = (P[i] ^ h, i), a permutation since i and P[i] ^ h give back h. So one row of K neighbours
in the table P, with h added to it, serves all coordinates, and since 32 bits of the least point are
compared, sets of millions of shingles do not meet by chance.

BANDS bands of ROWS coordinates: a pair of similarity s meets in one with probability
1 - (1 - s**ROWS)**BANDS, 0.999998 at 0.75. Every link between different sets is then confirmed on the
full sets of words, not of hashes: 100 * intersection >= 75 * union. Sets are equal when 128 bits of a
digest over all their shingle hashes are.

No group is gathered in one task and no large bucket is paired with itself:
1. documents of equal sets are summed to one representative (map-side combined);
2. each bucket names as centre the member whose buckets hold the most members in all, which in a
   group of near copies is the text that they come from; a document is checked against the
   centre that most of its buckets name;
3. links are contracted to components by alternating large and small stars. Pairs inside a
   component need no check;
4. in buckets of up to DIRECT members, what lies outside the largest component is checked
   against all members of other components;
5. in larger ones such a pair is checked only if it can be a link by its rarest shingles. A link
   shares 3/7 of both sizes' sum. So with each set in one order, rarest first, the first shared
   shingle leaves that many in either set: only prefixes are joined, on the shingle, with this
   condition, and what each set's marks show that the other lacks is taken off too.
   Members with more shingles of their own than a link can spare meet nobody.
   Any order gives the same links; ORDER_BITS slots of counts are enough to rank shingles.
So no candidate pair of different components is left out, by a check or by a bound that rules it out.

Null text counts as empty. Rows without a doc_id are linked with nothing: component_id is
null and kept true. Rows with one doc_id and different texts are all linked through that id, and each
of their texts is compared. Repeated rows are copies, all of one verdict: `deduplicated` keeps or drops them
together. Ties are broken by the least doc_id. An empty table gives no rows. Very long texts are read whole;
a task holds the sets of one Arrow batch. Columns besides id and text are not read, and `deduplicated`
returns them as they came, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.base import U64, checkpointed, flat, free_name, grams, lowered, mix, passes, plain_words, sequence_hash, span_hashes, spread_join, word_spans

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 48, 5
#: Members of a bucket up to which its pairs are checked without the bound on prefixes.
DIRECT = 16
#: Slots (as a power of two) of the table of counts that ranks shingles; its size is fixed.
ORDER_BITS = 18
#: Words of 64 bits in which a set marks its shingles: a mark that another set lacks is a shingle that it lacks.
MARKS = 8
_MARKED = [f"m{k}" for k in range(MARKS)]
#: Bits of a point that the circular shift turns, and what sigma mixes in.
SPACE_BITS, SIGMA = 20, U64(0x6A09E667F3BCC909)
#: Rows (of up to five numbers) for candidate documents that may be broadcast to pick their texts; above it they are joined by shuffle.
BROADCAST_IDS = 2_000_000

_tables: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """The rows of P: row i holds P[i], P[i + 1], ..., K of them."""
    if not _tables:
        table = np.random.RandomState(7).randint(0, 2**32, 1 << SPACE_BITS, dtype=np.uint32)
        around = np.concatenate([table, table[: BANDS * ROWS - 1]])
        _tables.append(np.lib.stride_tricks.sliding_window_view(around, BANDS * ROWS))
    return _tables


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted set of a document's shingle hashes."""
    if not len(words):
        return words
    return np.unique(grams(words, SHINGLE)) if len(words) >= SHINGLE else sequence_hash(words)


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text."""
    data, at = flat(column)
    for i, j in passes(at):
        low = lowered(data[at[i] : at[j]])
        start, end, first = word_spans(low, at[i : j + 1] - at[i])
        h = span_hashes(low, start, end)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield shingles(h[a:b])


def signature(own: np.ndarray) -> np.ndarray:
    rows = tables()[0]
    point = mix(own ^ SIGMA)
    at, high = (point >> U64(64 - SPACE_BITS)).astype(np.int64), point.astype(np.uint32)[:, None]
    out = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(at), 256):
        np.minimum(out, (rows[at[k : k + 256]] ^ high[k : k + 256]).min(0), out=out)
    return out


_WEIGHTS = mix(np.arange(100, 100 + ROWS, dtype=U64)) | U64(1)


def bands(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((mix(sig.astype(U64)).reshape(BANDS, ROWS) * _WEIGHTS).sum(1, dtype=U64) + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, a, b, blobs = [], [], [], []
        for own in sets(batch.column(1)):
            n.append(len(own))
            both = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
            a.append(int(both[0]))
            b.append(int(both[1]))
            blobs.append(bands(signature(own)).view(np.int64) if len(own) else np.zeros(0, np.int64))
        at = np.concatenate([[0], np.cumsum([len(x) for x in blobs])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*blobs, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])


def _word_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as its words, lower-cased, one space between."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b" ".join(plain_words(x.lower())) for x in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "own"])


def alike(a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """Whether two texts' sets of shingles are a link. Exact: words are numbered, and runs of 1, 2, 4 and 5 words numbered by doubling."""
    if a == b:
        return bool(a)
    both = a.split(b" "), b.split(b" ")
    if min(map(len, both)) < SHINGLE:
        return False  # one shingle that is the whole sequence, and they differ
    number: dict[bytes, int] = {}
    one = np.fromiter((number.setdefault(w, len(number)) for own in both for w in own), np.int64)
    two = np.unique(one[:-1] * len(number) + one[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * len(one) + two[2:], return_inverse=True)[1]
    five = four[:-1] * len(number) + one[4:]
    x, y = np.unique(five[: len(both[0]) - SHINGLE + 1]), np.unique(five[len(both[0]) :])
    inter = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yes = []
        texts = [batch.column(k).to_pylist() for k in (2, 3)]
        for x, y, s, t in zip(sets(batch.column(2)), sets(batch.column(3)), *texts, strict=True):
            if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                yes.append(False)
                continue
            both = np.sort(np.concatenate([x, y]), kind="stable")
            inter = int((both[1:] == both[:-1]).sum())
            # hashes rule out most; what they let pass is decided by the words
            yes.append(100 * inter >= PERCENT * (len(x) + len(y) - inter) and alike(s, t))
        keep = pa.array(yes, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])


def confirmed(pairs: DataFrame, light: DataFrame) -> DataFrame:
    """Of the checkpointed pairs (u, v), those whose full sets are alike enough."""
    ids = pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "doc_id")
    if pairs.count() * 2 <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # a text for each id; of an id with several texts, each
    own = light.join(ids, "doc_id", "left_semi").mapInArrow(_word_blobs, "doc_id long, own binary")
    left, right = own.select(F.col("doc_id").alias("u"), F.col("own").alias("a")), own.select(F.col("doc_id").alias("v"), F.col("own").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_linked, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least id reachable, by alternating large and small stars with a checkpoint each round.

    Nodes of large degree are never gathered: each star is a minimum (map-side combined) and an equi-join.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state or not now.n:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        edges = checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v"))).where("u != v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task fall in each slot."""
    count = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        for own in sets(batch.column(1)):
            np.add.at(count, (own >> U64(64 - ORDER_BITS)).astype(np.int64), 1)
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at], pa.int64())], ["slot", "k"])


def prefix_length(n: int, least: int) -> int:
    """How many of a set's n shingles, rarest first, hold one that it shares with each set linked to it, none of which is below `least`."""
    return n + 1 + (-3 * (n + max(least, -(-3 * n // 4)))) // 7


def _prefixes(counts):  # noqa: ANN001, ANN202
    """A mapper of (doc_id, text, c, outside, least) to rows for the rarest shingles of each set, with their place in it."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = counts.value
        for batch in batches:
            shingle, size, place, row, marks = [], [], [], [], []
            for i, (own, least) in enumerate(zip(sets(batch.column(1)), batch.column(4).to_pylist(), strict=True)):
                n = len(own)
                k = prefix_length(n, least)
                # own is sorted by hash, so a stable sort by count breaks ties alike in all sets
                shingle.append(own[np.argsort(rank[(own >> U64(64 - ORDER_BITS)).astype(np.int64)], kind="stable")[:k]])
                size.append(np.full(len(shingle[-1]), n))
                place.append(np.arange(len(shingle[-1])))
                row.append(np.full(len(shingle[-1]), i))
                bits = np.zeros(64 * MARKS, np.uint8)
                bits[(own % U64(64 * MARKS)).astype(np.int64)] = 1
                marks.append(np.packbits(bits).view(np.int64))
            at = pa.array(np.concatenate([*row, np.zeros(0, np.int64)]).astype(np.int64))
            numbers = [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (size, place)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*shingle, np.zeros(0, U64)]).view(np.int64)), batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at), *numbers, *[pa.array([x[k] for x in marks], pa.int64()).take(at) for k in range(MARKS)]],
                ["shingle", "rep", "c", "outside", "n", "place", *_MARKED],
            )

    return mapper


def _centred(shared: DataFrame) -> DataFrame:
    """Each representative with the centre that most of its buckets name."""
    weight = shared.groupBy("rep").agg(F.sum("members").alias("weight"))
    centre = shared.join(weight, "rep").groupBy("band").agg(F.max(F.struct("weight", (-F.col("rep")).alias("least")))["least"].alias("least")).select("band", (-F.col("least")).alias("centre"))
    often = shared.join(centre, "band").where("rep != centre").groupBy("rep", "centre").agg(F.count(F.lit(1)).alias("k"))
    return _pairs(often.groupBy("rep").agg((-F.max(F.struct("k", (-F.col("centre")).alias("v")))["v"]).alias("v")).select(F.col("rep").alias("u"), "v"))


def _open(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Members (band, rep, c, main, members, least) of buckets that still hold several components; main is the bucket's largest, least its smallest set."""
    of = F.coalesce("component", "rep")
    placed = shared.join(found, F.col("rep") == F.col("node"), "left").select("band", "rep", "n_shingles", "members", of.alias("c"))
    sizes = placed.groupBy("band", "c").agg(F.count(F.lit(1)).alias("k"), F.min("n_shingles").alias("least"))
    main = sizes.groupBy("band").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.min("least").alias("least"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return checkpointed(placed.join(main, "band").select("band", "rep", "c", "main", "members", "least"))


def _pairs(both: DataFrame) -> DataFrame:
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _few(left: DataFrame) -> DataFrame:
    """All pairs across components of small buckets."""
    left = left.where(F.col("members") <= DIRECT)
    x = left.where("c != main").select("band", F.col("rep").alias("u"), F.col("c").alias("cu"))
    y = left.select("band", F.col("rep").alias("v"), F.col("c").alias("cv"), "main")
    return _pairs(x.join(y, "band").where("cu != cv AND (cv = main OR u < v)"))


def _many(left: DataFrame, light: DataFrame) -> DataFrame | None:
    """Pairs across components of large buckets that their rarest shingles don't rule out; None without such buckets."""
    sc = light.sparkSession.sparkContext
    each = left.where(F.col("members") > DIRECT).groupBy("rep").agg(F.first("c").alias("c"), F.max(F.expr("c != main")).alias("outside"), F.min("least").alias("least"))
    each = checkpointed(each)
    if each.count() <= BROADCAST_IDS:
        each = F.broadcast(each)
    texts = checkpointed(light.join(each, F.col("doc_id") == F.col("rep")).select("doc_id", "text", "c", "outside", "least"))
    slots = texts.mapInArrow(_slots, "slot long, k long").groupBy("slot").agg(F.sum("k").alias("k")).collect()  # at most 2 ** ORDER_BITS rows
    if not slots:
        return None
    rank = np.zeros(1 << ORDER_BITS, np.int64)
    rank[[x.slot for x in slots]] = [x.k for x in slots]
    rows = checkpointed(texts.mapInArrow(_prefixes(sc.broadcast(rank)), "shingle long, rep long, c long, outside boolean, n long, place long, " + ", ".join(f"{m} long" for m in _MARKED)))
    x = rows.where("outside").select("shingle", F.col("rep").alias("u"), F.col("c").alias("cu"), F.col("n").alias("nu"), F.col("place").alias("pu"), *[F.col(m).alias(f"u{m}") for m in _MARKED])
    y = rows.select("shingle", F.col("rep").alias("v"), F.col("c").alias("cv"), F.col("n").alias("nv"), F.col("place").alias("pv"), F.col("outside").alias("both"), *[F.col(m).alias(f"v{m}") for m in _MARKED])
    lacks = lambda a, b: " + ".join(f"bit_count({a}{m} & ~{b}{m})" for m in _MARKED)
    spare = f"7 * (nu - ({lacks('u', 'v')})) >= 3 * (nu + nv) AND 7 * (nv - ({lacks('v', 'u')})) >= 3 * (nu + nv)"
    return _pairs(x.join(y, "shingle").where(f"cu != cv AND (NOT both OR u < v) AND 7 * (nu - pu) >= 3 * (nu + nv) AND 7 * (nv - pv) >= 3 * (nu + nv) AND {spare}"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_shingles, component_id and kept."""
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = checkpointed(light.mapInArrow(_signed, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"))
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    one = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    # documents of equal sets share their bands, so any of them will do
    member = one.select("rep", "n_shingles", F.explode("bands").alias("band"))
    sizes = member.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = checkpointed(member.join(sizes, "band").select("band", "rep", "n_shingles", "members"))
    found = light.sparkSession.createDataFrame([], "node long, component long")
    tested = checkpointed(_centred(shared))
    links = checkpointed(confirmed(tested, light))
    if not links.isEmpty():
        found = components(links)
    left = _open(shared, found)
    if not left.isEmpty():
        rest, many = _few(left), _many(left, light)
        rest = checkpointed((rest.union(many).distinct() if many is not None else rest).join(tested, ["u", "v"], "left_anti"))
        links = checkpointed(confirmed(rest, light))
        if not links.isEmpty():
            found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
    # rows of one id and different sets are linked through the id
    both = F.struct("s1", "s2")
    double = checkpointed(some.groupBy("doc_id").agg(F.min(both).alias("a"), F.max(both).alias("b")).where("a != b").select(F.col("doc_id").alias("u")))
    if not double.isEmpty():
        tied = some.join(double, F.col("doc_id") == F.col("u")).select("u", "s1", "s2").distinct().join(one.select("s1", "s2", F.col("rep").alias("v")), ["s1", "s2"]).select("u", "v")
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(tied))
    # a set that several rows have knows its component; other rows ask by their id. Keys that must meet nothing are hashes of the row's place
    linked = F.expr("n_shingles > 0 AND doc_id IS NOT NULL")
    copy = checkpointed(one.where("copies > 1").join(found, F.col("rep") == F.col("node"), "left").select("s1", "s2", "copies", F.coalesce("component", "rep").alias("of")))
    row = signed.select("doc_id", "n_shingles", "s1", "s2", F.monotonically_increasing_id().alias("at"))
    row = row.select("doc_id", "n_shingles", *[F.when(linked, F.col(c)).otherwise(F.xxhash64(F.lit(c), "at")).alias(c) for c in ("s1", "s2")], "at")
    row = spread_join(row, copy, ["s1", "s2"], "copies", "at")
    asks = F.col("of").isNull() & linked
    row = row.withColumn("key", F.when(asks, F.col("doc_id")).otherwise(F.xxhash64("at"))).withColumn("asks", asks)
    out = row.join(found, F.expr("key = node AND asks"), "left").withColumn("component_id", F.coalesce("of", "component", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns as they came; documents linked with nothing all stay."""
    name = free_name("gone", docs.columns)
    gone = classes(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(f"`{name}`"), "left_anti")
