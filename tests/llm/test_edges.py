"""What texts, ids and tables can be at worst: structured words that break weak hashes, nulls, repeated rows, very long texts, empty tables, clashing names."""

import random
import re
from collections import Counter

import pytest

from test_llm import WORD, sha


def thue_morse(n, a="a", b="b"):
    """Two complementary sequences: every polynomial hash mod 2**64 with an odd base confuses them from about 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def removed_words(texts, width=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {k + d for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for d in range(width)}
        out.append((len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def removed_bytes(texts, width=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + width] for b in raw for k in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone) if not y))))
    return out


def components(texts):
    own = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(own)))
    changed = True
    while changed:
        changed = False
        for i in range(len(own)):
            for j in range(i):
                if own[i] and own[j] and root[i] != root[j] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return [(len(o), r) for o, r in zip(own, root)]


@pytest.mark.parametrize("n", [512, 2048])
def test_complementary_texts_are_neither_linked_nor_cut(spark, n):
    from mnemolake.llm import minhash, packing, substrings, suffixes

    x, y = thue_morse(n)
    tail = [f"q{k}" for k in range(34)]
    texts = ["".join(x), "".join(y), " ".join(["".join(x), *tail]), " ".join(["".join(y), *tail]), " ".join(x), " ".join(y), " ".join(["".join(x)] * 2), " ".join(["".join(y)] * 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(docs).collect()}
    assert got == dict(enumerate(components(texts)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(docs).collect()}
    assert got == dict(enumerate(removed_words(texts))) and not got[2][1] and not got[3][1]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs).collect()}
    assert got == dict(enumerate(removed_bytes(texts)))
    few = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    clusters = {r.doc_id: r.cluster for r in packing.measured(few.withColumn("source", few.doc_id.cast("string"))).collect()}
    assert len(set(clusters.values())) == len(texts)


def test_long_unrelated_texts_share_no_coordinates():
    import numpy as np

    from mnemolake.llm import minhash

    draw = np.random.RandomState(3)
    a, b = (minhash.signature(np.unique(draw.randint(0, 2**63, 300_000).astype(np.uint64) * np.uint64(2))) for _ in range(2))
    assert (a == b).sum() <= 1


def test_alike_is_the_definition():
    from mnemolake.llm.minhash import alike

    draw = random.Random(5)
    for _ in range(400):
        a = [draw.choice("abc") for _ in range(draw.randint(1, 14))]
        b = list(a)
        for _ in range(draw.randint(0, 2)):
            b[draw.randrange(len(b))] = draw.choice("abcd")
        b = b[: draw.randint(1, 14)]
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for w in (a, b)]
        want = 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1])
        assert alike(" ".join(a).encode(), " ".join(b).encode()) == want
    assert not alike(b"", b"")


def test_minhash_near_copy_of_the_second_text_of_a_doubled_id(spark):
    from mnemolake.llm import minhash

    one, two = [" ".join(f"{c}{k}" for k in range(60)) for c in "xy"]
    near = " ".join([*two.split()[:-1], "other"])
    docs = spark.createDataFrame([(5, one), (5, two), (7, near), (8, one + " more"), (9, "nothing of the kind at all")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.classes(docs).collect()) == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_minhash_many_copies_and_rows_without_words(spark):
    """Sets with a large share of all rows are joined by broadcast, the rest by shuffle: the same answer."""
    from mnemolake.llm import minhash

    a, b = "one text that very many rows hold word for word", "another text that two of them hold in full"
    rows = [(i, a) for i in range(200)] + [(1000 + i, "") for i in range(80)] + [(2000, b), (2001, b), (2002, None), (None, a), (None, "")]
    rows += [(3000 + i, f"row {i} of its own has words that no other one has {i * 7}") for i in range(40)]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    by = {r.doc_id: (r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert len(got) == len(rows) and all(by[i] == (0, i == 0) for i in range(200)) and all(by[1000 + i] == (1000 + i, True) for i in range(80))
    assert by[2000] == (2000, True) and by[2001] == (2000, False) and by[2002] == (2002, True) and all(by[3000 + i][1] for i in range(40))
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def test_minhash_clashing_names(spark):
    from mnemolake.llm import minhash

    names = ["gone", "GONE_", "component_id", "kept", "node", "rep", "u", "__gone"]
    rows = [(i, t, *range(len(names))) for i, t in enumerate(["a b c d e f", "a b c d e f", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 2, 3]


REPEATED = [" ".join(f"w{k}" for k in range(60)), "z" * 900, " ".join(["again"] * 120), None, "", "short"]


def test_repeated_rows_and_null_ids_are_cut_as_any(spark):
    from mnemolake.llm import substrings, suffixes

    texts = [t for t in REPEATED for _ in range(3)] + [REPEATED[0] + " tail", "head " + REPEATED[0]]
    for ids in ([None] * len(texts), [7] * len(texts), list(range(len(texts)))):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(docs).collect()), key=str)
        assert got == sorted(((i, *x) for i, x in zip(ids, removed_words(texts))), key=str)
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs).collect()), key=str)
        assert got == sorted(((i, *x) for i, x in zip(ids, removed_bytes(texts))), key=str)


def test_small_flushes_and_buckets_change_nothing(spark, monkeypatch):
    """Many payloads of a few places each, many buckets to a partition."""
    from mnemolake.llm import anchors, substrings, suffixes

    draw = random.Random(9)
    vocab = [f"v{k}" for k in range(40)]
    part = [" ".join(draw.choice(vocab) for _ in range(70)) for _ in range(4)]
    texts = [" ".join([*(draw.choice(vocab) for _ in range(draw.randint(0, 30))), draw.choice(part), *(draw.choice(vocab) for _ in range(draw.randint(0, 30)))][draw.randint(0, 3) :]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for name, value in (("GROUP", 3), ("GROUP_BYTES", 2000), ("BUCKET_BYTES", 400)):
        monkeypatch.setattr(anchors, name, value)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(docs).collect()}
    assert got == dict(enumerate(removed_words(texts))) and sum(x[1] for x in got.values()) > 2000
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs).collect()}
    assert got == dict(enumerate(removed_bytes(texts)))


def test_long_texts_of_one_letter(spark):
    from mnemolake.llm import substrings, suffixes

    n = 150_000
    docs = spark.createDataFrame([(0, "a" * n), (1, "a " * n)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.digests(docs).collect()}
    assert got == {0: (n, n, 1), 1: (2 * n, 2 * n, 1)}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.digests(docs).collect()}
    assert got == {0: (1, 0), 1: (n, n)}


def best_fit_violations(rows, texts, source, capacity):
    """Replays a packing in the stated order: pieces that were not put into a tightest compatible bin."""
    words = {i: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t in texts.items()}
    rest = [r for r in rows if r.bin_id is not None and r.n_words < capacity]
    bins, wrong = {}, []
    for r in sorted(rest, key=lambda r: (-r.n_words, r.doc_id)):
        mark = (source(r.doc_id), tuple(words[r.doc_id]))
        fits = {b: left for b, (left, own) in bins.items() if left >= r.n_words and not any(s is not None and s == mark[0] or w == mark[1] for s, w in own)}
        if r.bin_id not in bins:
            if fits:
                wrong.append(r)
            bins[r.bin_id] = (capacity, [])
        elif r.bin_id not in fits or fits[r.bin_id] != min(fits.values()):
            wrong.append(r)
        left, own = bins[r.bin_id]
        bins[r.bin_id] = (left - r.n_words, [*own, mark])
    return wrong


def test_packing_replayed_and_across_groups(spark):
    from mnemolake.llm import packing

    draw = random.Random(12)
    texts = {i: " ".join(f"w{draw.randrange(9)}x{i if draw.random() < 0.8 else 0}" for _ in range(draw.randint(0, 70))) for i in range(300)}
    texts |= {300 + i: texts[i] for i in range(20)}
    source = lambda i: None if i % 7 == 0 else f"s{i % 12}"
    docs = spark.createDataFrame([(i, t, source(i)) for i, t in texts.items()], "doc_id long, text string, source string")
    whole = packing.packed(docs, capacity=100).collect()
    assert best_fit_violations(whole, texts, source, 100) == []
    counts = {}
    for group, room in ((10_000, None), (25, None), (25, 101)):
        rows = packing.packed(docs, capacity=100, group=group, room=room).collect()
        held, bins = Counter(), {}
        for r in rows:
            held[r.doc_id] += r.n_words
            if r.bin_id is not None:
                bins.setdefault(r.bin_id, []).append(r)
        assert held == Counter({i: len(WORD.findall(t)) for i, t in texts.items()})
        for own in bins.values():
            marks = [source(r.doc_id) for r in own if source(r.doc_id)]
            assert sum(r.n_words for r in own) <= 100 and len(marks) == len(set(marks)) and len({texts[r.doc_id] for r in own}) == len(own)
        counts[group, room] = len(bins)
    # packed again across groups, the bins are fewer than without
    assert counts[10_000, None] <= counts[25, None] < counts[25, 101]


def test_packing_repeated_rows_and_null_ids(spark):
    from mnemolake.llm import packing

    rows = [(None, "a b c", None)] * 40 + [(3, "d e f", "s")] * 40 + [(4, None, None), (None, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS bin_id", "2 AS cluster", "3 AS key")
    got = packing.packed(docs, capacity=10, group=8).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter({(None, 3): 40, (3, 3): 40, (4, 0): 1, (None, 0): 1})
    # copies conflict: at most one of each text to a bin
    bins = Counter(r.bin_id for r in got if r.bin_id is not None)
    assert max(bins.values()) == 2 and len(bins) >= 40


def test_lines_hot_keys_repeated_rows_and_names(spark):
    from mnemolake.llm import lines

    hot, some = "a line that nearly every document holds", "a line that a few of the documents hold"
    rows = [(i, f"{hot}\nown line of document number {i}") for i in range(150)] + [(200 + i, f"{some}\n{hot}\n{some}") for i in range(4)] + [(7, f"{hot}\nown line of document number 7"), (None, hot), (None, hot), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h1", "2 AS doc", "3 AS last", "4 AS `__row`", "5 AS rows")
    left = lines.deduplicated(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    want = [(i, f"own line of document number {i}") for i in range(150)] + [(200 + i, "") for i in range(3)] + [(203, f"{some}\n{hot}\n{some}"), (7, "own line of document number 7"), (None, hot), (None, hot), (300, None), (301, "")]
    assert got == sorted(want, key=str)
    n = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.digests(docs).collect()}
    assert n[200] == (3, 3) and n[203] == (3, 0) and n[0] == (2, 1) and n[300] == (1, 0)


def test_bpe_long_texts_segments_and_tables(spark, monkeypatch):
    import numpy as np
    from tokenizers import Tokenizer

    from mnemolake.llm import bpe
    from mnemolake.llm.queries import vocabulary

    lib = Tokenizer.from_file(vocabulary())
    draw = random.Random(21)
    texts = [None, "", " ", "The End's nigh", "The End's nigh", "a" * 200_000, "é̀" * 30_000, "=-" * 50_000, "x<|endoftext|>y" * 9000, "İstanbul ΑΣ ́b \n" * 9000, " ".join(draw.choice(["über", "naïve", "it's", "12", "中文", "é", "the"]) for _ in range(60_000))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "no id", 1, 2)], "doc_id long, text string, n_tokens int, ids int")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, vocabulary()).collect()}
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False))), i
    assert bpe.digests(docs.where("false"), vocabulary()).count() == 0
    # segments of any size give the same ids, and are the text
    machine = bpe.transducer(vocabulary())
    pieces = ["a", "it's", " ", "\n", "é", "́", "<|startoftext|>", "Σ", "中", " ", "\x85", "=="]
    for _ in range(300):
        t = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 60)))
        monkeypatch.setattr(bpe, "SEGMENT", 7)
        assert "".join(bpe.segments(t, 7)) == t and list(machine.encode(t)) == lib.encode(t, add_special_tokens=False).ids
    # a sequence cut within a character is held
    back = bpe.Decoder(["\xe4", "\xb8", "\xad"], lambda s: s.encode("latin-1"), b"")
    assert [back.feed([0]), back.feed([1]), back.feed([2]), back.end()] == ["", "", "中", ""]


def test_bpe_streaming_equals_remembered_states():
    from mnemolake.llm import bpe
    from mnemolake.llm.queries import vocabulary

    machine, draw = bpe.transducer(vocabulary()), random.Random(22)
    for _ in range(400):
        word = "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 40)))
        assert tuple(machine.word(word)) == machine.short(word)


def test_fingerprints_against_brute_force(spark):
    """Terms, lexicon, subsets, parts and likeness in plain Python; hashes of single terms are taken from the operator."""
    import numpy as np
    import xxhash

    from mnemolake.llm import fingerprints as f
    from mnemolake.llm.base import span_hashes

    draw = random.Random(31)
    vocab = [f"{a}{k}" for k in range(150) for a in ("Term", "größe", "(x", "it's")]
    texts = [" ".join(draw.choice(vocab[: draw.choice((20, 600))]) + draw.choice(("", ".", ",\n")) for _ in range(draw.randint(0, 120))) for _ in range(120)]
    texts += [texts[3], texts[3], None, "", " \n", "!!! ---", "x" * 5000, "none of these words are met twice"]
    rows = list(enumerate(texts)) + [(5, "a second text of id five term1 term2"), (None, texts[4]), (None, texts[4]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS place", "2 AS extra", "3 AS n_chars").repartition(7)

    def terms(t):
        words = [re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", w) for w in WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))]
        return {w for w in words if w}

    def hashed(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])

    df = Counter(w for _, t in rows for w in terms(t or ""))
    lexicon = {w for w, n in df.items() if n >= max(2, 0.02 * len(rows)) and n <= 0.5 * len(rows)}
    assert 50 < len(lexicon) < len(df)

    def fingerprint(t):
        own = np.array(sorted(hashed(w) for w in terms(t) & lexicon), np.uint64)
        kept = [own[f.subset_keeps(s, own)] for s in range(f.SUBSETS)]
        return ".".join(f"{xxhash.xxh3_64_intdigest(k.tobytes()):016x}" if len(k) else "-" for k in kept)

    def likeness(a, b, same):
        both = [(x, y) for x, y in zip(a.split("."), b.split(".")) if (x, y) != ("-", "-")]
        return sum(x == y for x, y in both) / len(both) if both else float(same)

    order = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (r[0], r[1].encode()))
    chain = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)] + [(None, t or "", t or "") for i, t in rows if i is None]
    want = []
    for i, t, after in chain:
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = fingerprint(t), fingerprint(new), fingerprint(after)
        want.append((i, len(t), sha(new), a, b, likeness(a, b, t == new), likeness(a, c, t == after)))
    got = [tuple(r) for r in f.digests(docs, least=0.02, most=0.5).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[3].split(".")[-1] != "-" and 0 < r[5] < 1 for r in got)
    one = f.digests(spark.createDataFrame([(1, "only one")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 8)]
    assert f.digests(docs.where("doc_id IS NULL AND text IS NULL")).count() == 1 and f.digests(docs.where("false")).count() == 0


def test_toxicity_without_labels_and_documents(spark):
    from mnemolake.llm import toxicity as t

    docs = spark.createDataFrame([(1, "some words"), (2, None), (2, ""), (None, "idiot words")], "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS __id", "3 AS p_toxic")
    schema = "doc_id long, quality int, toxic int"
    for labels in ([], [(None, 1, 1), (1, 1, None)], [(77, 0, 1)]):
        model = t.calibrated(*t.sampled(docs, spark.createDataFrame(labels, schema)))
        assert not any(r.toxic for r in t.scored(docs, model).collect()) and t.scored(docs, model).count() == 4
        assert t.scored(docs.where("false"), model).count() == 0
    one = t.calibrated(*t.sampled(docs, spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1)], schema)))
    assert t.scored(docs, one).count() == 4
    empty = t.calibrated(*t.sampled(docs.where("false"), spark.createDataFrame([(1, 1, 1)], schema)))
    assert t.scored(docs, empty).count() == 4


def test_toxicity_scores_are_the_formula(spark):
    """Severity by plain Python from the model's weights and thresholds."""
    import math

    import numpy as np

    from mnemolake.llm import toxicity as t
    from mnemolake.llm.base import span_hashes

    draw = np.random.RandomState(3)
    model = t.Model(draw.randn(1 << t.BITS).astype(np.float32), np.array([0.3, 1.1]), 0.4)
    texts = ["Ein IDIOT, ein Idiot!", "größe 12-3", "", None, "... !!", "word " * 5000, "x" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in t.scored(docs, model).collect():
        words = set(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (texts[r.doc_id] or "").encode().lower()))
        places = {int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> (64 - t.BITS) for w in words}
        margin = sum(float(model.weights[p]) for p in places)
        p = [1 / (1 + math.exp(th - margin)) for th in model.thresholds]
        assert (r.p_toxic, r.p_severe, r.expected_severity) == pytest.approx((p[0], p[1], sum(p)))
        assert r.toxic == (p[0] >= 0.4) and r.grade == (0 if not r.toxic else 1 if p[0] - p[1] >= p[1] else 2)


def test_pii_added_kinds_against_brute_force():
    from mnemolake.llm import pii

    def urls(t):
        return [m.span() for m in re.finditer(r"[A-Za-z0-9+.-]+://[^\s/@:]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+\S*", t)]

    def valid(x):
        x = x.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    def accounts(t):
        out, end = [], 0
        cues = "|".join(f"{c}|{c.upper()}|{c.title()}" for c in pii.CUES)
        for m in re.finditer(rf"(?={cues})", t):
            cue = re.match(cues, t[m.start() :])[0]
            if m.start() < end or (m.start() and t[m.start() - 1].isalnum()):
                continue
            rest = m.start() + len(cue)
            gap = rest + len(re.match(r"\W{0,3}", t[rest:])[0])
            iban = re.match(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", t[gap:])
            cuts = [iban[0][:k] for k in range(len(iban[0]), 0, -1) if k == len(iban[0]) or iban[0][k] == " "] if iban else []
            cuts = [c for c in cuts if re.fullmatch(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", c)]
            good = next((c for c in cuts if valid(c)), None)
            named = re.match(r"(?:\x20?(?:no|nr|number|num|id)\b\.?)?\x20?[:#=]?\x20?([A-Z]{0,4}[0-9](?:[-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])", t[rest:])
            if good:
                out.append((gap, gap + len(good)))
            elif named:
                out.append((rest + named.start(1), rest + named.end(1)))
            else:
                continue
            end = out[-1][1]
        return out

    draw = random.Random(41)
    parts = ["account", "ACCOUNT", "Konto", "iban", "IBAN", " ", " ", ": ", "#", "no. ", "nr", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89370400440532013001", "X12345678", "12-34-56-78", "1234567", "x", "é", "\n", "http://", "user:pw@host.org/x", "u@h", "://", "ftp://a:b@", "k.com", ".", "/"]
    for _ in range(20_000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 9)))
        found = pii.spans(t)
        assert [x[1:] for x in found if x[0] == "url"] == urls(t), t
        assert [x[1:] for x in found if x[0] == "account"] == accounts(t), t


def test_pii_tables(spark):
    from mnemolake.llm import pii

    long = "mail me at a.b@c.org or +49 30 1234567 " * 20_000
    docs = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "1.2.3.4"), (None, None), (2, long)], "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS n_ip")
    got = pii.detected(docs).collect()
    assert sorted((r.n_email, r.n_ip) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 0), (20_000, 0)]
    assert [r.n_phone for r in got if r.doc_id == 2] == [20_000] and pii.detected(docs.where("false")).count() == 0
    left = pii.redacted_documents(docs)
    assert left.columns == docs.columns and {r.text for r in left.collect() if r.doc_id == 1} == {"[EMAIL]"} and left.where("text IS NULL").count() == 1


def judged(t):
    """The quality rules in plain Python."""
    from mnemolake.llm.quality import STOP_WORDS

    t = t or ""
    w, ls = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    rep = {k + d for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for d in range(5)}
    if len(w) < 10 or 100 * len(rep) > 20 * len(w):
        return False
    chars = "".join(w)
    return (
        1.5 <= len(chars) / len(w) <= 14 and len(re.findall(r"[#*$%&|<>]", t)) <= 0.25 * len(w) and chars.count("!") <= 0.35 * len(w) and len(re.findall("[A-Z]", chars)) <= 0.6 * len(chars)
        and sum(x.lower() in STOP_WORDS for x in w) >= 0.02 * len(w) and len(ls) - len(set(ls)) <= 0.5 * max(len(ls), 1)
    )


def test_quality_verdict_long_and_repeated_rows(spark):
    from mnemolake.llm import quality

    draw = random.Random(51)
    vocab = ["the", "of", "und", "la", "Word", "UPPER", "größe", "x!", "#a", "b|c", "nothing", "verylongwordindeedthatis", "it"]
    texts = [" ".join(draw.choice(vocab[: draw.randint(1, 13)]) + draw.choice(["", "", "", "\n"]) for _ in range(draw.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(f"the{k}x of y{k}" for k in range(30_000)), "same line of the text\n" * 3000, None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])], "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS __text", "3 AS n_words", "4 AS __kept", "5 AS `__row`")
    got = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert got == {i: judged(t) for i, t in enumerate(texts)} | {None: judged(texts[1])} and 5 < sum(got.values()) < len(got) - 5
    left = quality.kept_documents(docs)
    assert left.columns == docs.columns and left.count() == sum(map(judged, [*texts, texts[0], texts[1]]))


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages over rows with nulls, repeats and clashing names, in plain Python but for the redaction of one text."""
    import corpus_pipeline as c
    from mnemolake.llm import packing, pii

    draw = random.Random(61)
    vocab = "the of and to in is that it for on was as with be by this at from or an not have but they which you".split() + [f"word{k}" for k in range(60)]
    para = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    line = "A licence line of the many documents that hold it"
    texts = [para(draw.randint(5, 90)) + draw.choice(["", f"\n{line}", f"\n{line.upper()}  ", " mail a.b@c.org now", " at 10.0.0.1"]) for _ in range(90)]
    texts += [texts[k] for k in (3, 3, 9)] + [texts[k] + " one more word" for k in (11, 12)] + [None, "", " \n", para(5000), line]
    rows = [(i, t, draw.choice(["a", "b", "c", None]), 0, i % 3) for i, t in enumerate(texts)]
    rows += [rows[20], (21, para(40), "a", 0, 9), (None, para(50), "a", 0, 1), (None, line + "\n" + para(50), None, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, gone int").selectExpr("*", "1 AS h1", "'x' AS `__row`", "2 AS component_id")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    low = {k: k + 32 for k in range(65, 91)}

    left = [r for r in rows if judged(r[1])]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    where = {}
    for r in left:
        for x in r[1].split("\n") if r[0] is not None else ():
            where.setdefault(key(x), set()).add(r[0])
    drop = lambda i, x: i is not None and len(key(x)) >= 20 and len(where[key(x)]) >= 3 and max(where[key(x)]) != i
    left = [(r[0], "\n".join(x for x in r[1].split("\n") if not drop(r[0], x)), r[2]) for r in left]
    some = [r for r in left if r[0] is not None]
    root = {r[0]: r[0] for r in some}
    for a, (_, at) in zip(some, components([r[1] for r in some]), strict=True):
        for x, y in ((root[a[0]], root[some[at][0]]), (root[some[at][0]], root[a[0]])):
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    left = [(i, pii.redacted(t), s) for i, t, s in left if i is None or root[i] == i]
    words = Counter()
    for i, t, _ in left:
        n = len(WORD.findall(t))
        words.update([(i, k, packing.CAPACITY) for k in range(n // packing.CAPACITY)] + [(i, n // packing.CAPACITY, n % packing.CAPACITY)] * bool(n % packing.CAPACITY or not n))
    got = c.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.n_words) for r in got) == words and len(left) < len(rows) - 5
    sources = {(i, len(WORD.findall(t))): s for i, t, s in left}
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for own in bins.values():
        marks = [m for r in own if (m := sources.get((r.doc_id, r.piece * packing.CAPACITY + r.n_words)))]
        assert sum(r.n_words for r in own) <= packing.CAPACITY and len(marks) == len(set(marks))
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert c.run(spark, f"{tmp_path}/none").count() == 0
    for name, stage in c.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.where("false"), "").count() == 0, name
