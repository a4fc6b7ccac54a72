"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Encoding reads a text's pre-tokens symbol by symbol. For each prefix of a pre-token there is
exactly one token that can end it: the token t whose left neighbour, the last token of the
prefix before t, forms a *stable pair* with it, that is, merging both halves' symbols by the
merge list gives back just the two. So the transducer keeps, for each of the last LOOKAHEAD
positions only, that last token; LOOKAHEAD is the longest token of the merge list in
symbols, the sufficient lookahead, since no later token can begin further back. Once all live
positions' paths run through one token, that token and all before it can never change: they
are stable, and are emitted. The transducer's states, the last token and all ids of a prefix, are
remembered for prefixes of up to SHORT symbols in a bounded cache, so that a short pre-token that begins
like another goes on from there; this changes nothing but the time. Merge rank order decides; special
strings are cut out first, as the tokenizer file says; text is NFC-normalised and lower-cased.

A text is read in segments of about SEGMENT characters, cut before a blank or line break: no
pre-token, special string, composition or case rule reaches across one. Ids leave in pieces of that
order too, so besides the text itself memory is constant, or as long as the longest run without a
blank or line break.

Decoding is the inverse machine: each id stands for some bytes, which an incremental UTF-8 machine turns
into text, holding a sequence until it is whole; ids come in pieces of any size. The file names no
decoder, so `Decoder` writes tokens as spelt, one space between; `decoded_bytes` runs the same machine
over the bytes that the spelling stands for, with word ends as spaces.

Null counts as the empty text: no tokens. Every row is encoded by itself; ties cannot arise, and repeated
rows are encoded alike. An empty table gives no rows. Columns besides id and text are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE, PAIRS, SHORT = 120_000, 300_000, 40
#: Characters of a segment of text, and ids of a piece.
SEGMENT = 1 << 16


class Memo(dict):
    """A bounded memo of a function: when full, the newer half replaces the older, so what is used stays."""

    def __init__(self, made: Callable, most: int = CACHE) -> None:
        super().__init__()
        self.made, self.most, self.older = made, most, {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        got = self.older.get(key)
        if got is None:
            got = self.made(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


def spelling() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Transducer:
    """Encoder for one tokenizer file of the word-end kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        #: The same pattern where a text is plain ASCII: the classes of letters, digits and white space written out.
        self.ascii_words = re.compile(split["pattern"]["Regex"].replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\s\p{L}\p{N}", r"\x09-\x0d\x20A-Za-z0-9"))
        self.spell = str.maketrans({b: c for b, c in enumerate(spelling())})
        self.strings = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = s
        #: The longest token in symbols: a pre-token's earlier positions can no longer begin a token.
        self.lookahead = max(len(s.removesuffix(self.end)) for s in self.vocab)
        self.stable: dict[tuple[str, str], bool] = {}
        self.memo, self.states = Memo(self.short), Memo(lambda prefix: self.state(prefix, ""))

    # --- the merge list ---

    def parts(self, token: str) -> list[str]:
        body = token.removesuffix(self.end) if self.end else token
        return list(body) if body == token else [*body[:-1], body[-1] + self.end]

    def merged(self, parts: list[str]) -> list[str]:
        """What the merge list makes of some symbols: the lowest rank first, the leftmost of equals."""
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair_is_stable(self, left: str, right: str) -> bool:
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            known = self.stable[left, right] = self.merged([*self.parts(left), *self.parts(right)]) == [left, right]
        return known

    # --- the transducer ---

    def tokens(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one pre-token's symbols, each as soon as it is stable; the last symbol carries the word end."""
        recent: list[str] = []  # the last `lookahead` symbols
        nodes: list[tuple] = [None]  # for each of the last positions: (token, node before), None at the start
        vocab, far, stable = self.vocab, self.lookahead, self.stable
        count = 0
        root = None  # what has been emitted ends here
        for symbol in symbols:
            recent.append(symbol)
            if len(recent) > far:
                del recent[0]
            count += 1
            n = len(recent)
            piece = ""
            found = None
            for k in range(1, n + 1):  # the shortest first; exactly one fits
                piece = recent[n - k] + piece
                if piece not in vocab:
                    continue
                before = nodes[-k]
                if before is None:
                    if self.whole(piece):
                        found = (piece, None)
                        break
                else:
                    left = before[0]
                    known = stable.get((left, piece))
                    if known if known is not None else self.pair_is_stable(left, piece):
                        found = (piece, before)
                        break
            nodes.append(found)
            if len(nodes) > far:
                del nodes[0]
            if count % 64 == 0 and len(nodes) == far:
                chains = []
                for node in nodes:
                    chain = []
                    while node is not root:
                        chain.append(node)
                        node = node[1]
                    chains.append(chain[::-1])
                common = 0
                while all(len(c) > common and c[common] is chains[0][common] for c in chains):
                    common += 1
                for node in chains[0][:common]:
                    yield node[0]
                if common:
                    root = chains[0][common - 1]
                    if root[1] is not None:
                        nodes = self._cut(nodes, root)
                        root = next(n for n in self._walk(nodes[-1]) if n[1] is _EMITTED)
        chain, node = [], nodes[-1]
        while node is not root:
            chain.append(node[0])
            node = node[1]
        yield from reversed(chain)

    @staticmethod
    def _walk(node: tuple) -> Iterator[tuple]:
        while node is not None and node is not _EMITTED:
            yield node
            node = node[1]

    @staticmethod
    def _cut(nodes: list[tuple], root: tuple) -> list[tuple]:
        """The live nodes, copied, with all before the last emitted one forgotten."""
        new = {id(root): (root[0], _EMITTED)}

        def copy(node: tuple) -> tuple:
            path = []
            while id(node) not in new:
                path.append(node)
                node = node[1]
            got = new[id(node)]
            for x in reversed(path):
                got = new[id(x)] = (x[0], got)
            return got

        return [copy(n) for n in nodes]

    def whole(self, token: str) -> bool:
        known = self.stable.get(("", token))
        if known is None:
            known = self.stable["", token] = self.merged(self.parts(token)) == [token]
        return known

    def symbols(self, word: str) -> Iterator[str]:
        """The spelling of a pre-token's bytes; the last one carries the word end."""
        last = ""
        for at in range(0, len(word), SEGMENT):
            for symbol in word[at : at + SEGMENT].encode("utf-8").decode("latin-1").translate(self.spell):
                if last:
                    yield last
                last = symbol
        yield last + self.end

    def word(self, word: str) -> Iterator[int]:
        """Ids of one pre-token."""
        return map(self.vocab.__getitem__, self.tokens(self.symbols(word)))

    def short(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token of up to SHORT characters."""
        spelt = word if word.isascii() and word.isalnum() else word.encode("utf-8").decode("latin-1").translate(self.spell)
        return self.state(spelt, self.end)[1] if len(spelt) <= SHORT else tuple(self.word(word))

    def state(self, spelt: str, end: str) -> tuple[str, tuple[int, ...]]:
        """The last token and all ids of a prefix (with `end`: of a whole pre-token), by the rule of `tokens` from remembered states."""
        vocab, stable, whole = self.vocab, self.stable, spelt + end
        for j in range(max(0, len(spelt) - self.lookahead), len(spelt)):
            piece = whole[j:]
            if piece not in vocab:
                continue
            if not j:
                if self.whole(piece):
                    return piece, (vocab[piece],)
                continue
            left, ids = self.states[spelt[:j]]
            known = stable.get((left, piece))
            if known if known is not None else self.pair_is_stable(left, piece):
                return piece, (*ids, vocab[piece])
        raise ValueError(f"no token ends {spelt!r}")

    def _plain(self, text: str) -> Iterator[Iterable[int]]:
        """Ids of each pre-token of a segment without special strings."""
        if text.isascii():
            words = self.ascii_words.findall(text.lower())
        else:
            words = self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if max(map(len, words), default=0) <= SHORT:
            return map(self.memo.__getitem__, words)
        return (self.memo[w] if len(w) <= SHORT else self.word(w) for w in words)

    def pieces(self, text: str) -> Iterator[array]:
        """The ids of a text, in pieces of about SEGMENT."""
        for segment in segments(text):
            out, at = array("I"), 0
            for m in self.cut.finditer(segment) if self.cut else ():
                out.extend(chain.from_iterable(self._plain(segment[at : m.start()])))
                out.append(self.special[m[0]])
                at = m.end()
            rest = chain.from_iterable(self._plain(segment[at:] if at else segment))
            while len(segment) > 2 * SEGMENT and (some := array("I", islice(rest, SEGMENT))):  # a run without blanks
                yield out + some
                out = array("I")
            out.extend(rest)
            yield out

    def encode(self, text: str) -> array:
        out = array("I")
        for piece in self.pieces(text):
            out += piece
        return out


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about `most` characters, each cut before a blank or line break."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at + 1, at + most), text.rfind("\n", at + 1, at + most))
        if cut < 0:
            ahead = [x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0]
            cut = min(ahead, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


_EMITTED = ("", None)


class _Said(dict):
    """The bytes of each id, worked out once; there are as many as the vocabulary has."""

    def __init__(self, made: Callable[[int], bytes]) -> None:
        super().__init__()
        self.made = made

    def __missing__(self, key: int) -> bytes:
        got = self[key] = self.made(key)
        return got


class Decoder:
    """Ids to text by way of bytes, in pieces. `strings` tells each id's token, `spoken` a token's bytes, and `between` stands between two."""

    def __init__(self, strings: list[str], spoken: Callable[[str], bytes] = str.encode, between: bytes = b" ") -> None:
        self.between = between
        self.began = False
        self.known = _Said(lambda i: spoken(strings[i]))
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """The text that is certain by now; a broken sequence becomes U+FFFD."""
        said = list(map(self.known.__getitem__, ids))
        if not said:
            return ""
        data = self.between.join(said)
        data, self.began = (self.between + data if self.began else data), True
        return self.machine.decode(data)

    def end(self) -> str:
        """What is left, and back to the start."""
        self.began = False
        return self.machine.decode(b"", True)


def decoded_bytes(strings: list[str], ids: Iterable[int], end: str = "</w>") -> Iterator[str]:
    """The UTF-8 text of the ids, in pieces."""
    back = {c: b for b, c in enumerate(spelling())}

    def spoken(token: str) -> bytes:
        body = token.removesuffix(end)
        return bytes(back.get(c, 63) for c in body) + (b" " if body != token else b"")

    machine = Decoder(strings, spoken, b"")
    for i in ids:
        yield machine.feed([i])
    yield machine.end()


_ready: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each worker and file."""
    if path not in _ready:
        _ready[path] = Transducer(path)
    return _ready[path]


def _numbered(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            rows = [machine.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_tokens, ids_sha256 and decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        decoder = Decoder(machine.strings)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                count, numbers, text = 0, hashlib.sha256(), hashlib.sha256()
                for ids in machine.pieces(t.as_py() or ""):
                    count += len(ids)
                    numbers.update(_numbered(ids))
                    text.update(decoder.feed(ids).encode())
                text.update(decoder.end().encode())
                n.append(count)
                a.append(numbers.hexdigest())
                b.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
