"""PII by anchor expansion: one Aho-Corasick pass finds at-signs, schemes and identifier cues; local parsers expand and validate.

The automaton's anchors are `@`, `+`, the digits, `://` and cue words (iban, account, ...). Each
hit is handed to the parsers of its kind, which read only the run of characters around it:
email, ip, card and phone give the leftmost non-overlapping spans of their published patterns
(a span that fails validation is dropped and not retried), `account` adds IBANs that pass
mod 97 and identifiers introduced by a cue word, `url` adds scheme addresses that carry
credentials. Positions are code points, ends exclusive. Null and empty texts have no spans.
Each row is read by itself, so ties, repeated rows, null ids and other columns don't matter; an
empty table gives no rows. Time is linear in the text, however long, and memory constant but for
the spans found: a parser never looks behind its kind's last end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "account", "url")
BASE = KINDS[:4]
#: Words that introduce an account identifier; fixed values.
CUES = ("account", "acct", "iban", "konto", "cuenta", "compte", "ssn", "passport")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_IDENT = re.compile(r"(?:\x20?(?:no|nr|number|num|id)\b\.?)?\x20?[:#=]?\x20?([A-Z]{0,4}[0-9](?:[-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
_GAP = re.compile(r"\W{0,3}")
_CREDENTIALS = re.compile(r"://[^\s/@:]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+[^\s]*")


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for x in "0123456789":
        out.add_word(x, ("digit", 1))
    out.add_word("@", ("at", 1))
    out.add_word("+", ("plus", 1))
    out.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.title()}:
            out.add_word(form, ("cue", len(cue)))
    out.make_automaton()
    return out


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans, by kind in the order of KINDS and then by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_at = card_at = phone_end = account_end = url_end = 0
    for last, (kind, width) in _ANCHORS.iter(text):
        at = last - width + 1
        if kind == "digit":
            if at >= ip_at:
                if m := _IP.match(text, at):
                    ip_at = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                        out["ip"].append(m.span())
                else:
                    ip_at = _DIGITS.match(text, at).end()
            if at >= card_at and (m := _CARD.match(text, at)):
                card_at = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                email_end = m.end()
                out["email"].append((start, email_end))
        elif kind == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c.isdecimal() for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "cue":
            if at >= account_end and (at == 0 or not text[at - 1].isalnum()):
                gap = last + 1
                m = _IDENT.match(text, gap)
                n = _GAP.match(text, gap).end()
                iban = _IBAN.match(text, n)
                while iban and not _mod97(iban[0].replace(" ", "")):
                    cut = iban[0].rpartition(" ")[0]
                    iban = _IBAN.fullmatch(text, n, n + len(cut)) if cut else None
                if iban:
                    account_end = iban.end()
                    out["account"].append(iban.span())
                elif m:
                    account_end = m.end()
                    out["account"].append(m.span(1))
        elif at >= url_end:
            start = at
            while start > url_end and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _CREDENTIALS.match(text, at)):
                url_end = m.end()
                out["url"].append((start, url_end))
    return [(k, a, b) for k in KINDS for a, b in out[k]]


def redacted(text: str, found: list[tuple[str, int, int]] | None = None) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first start names the whole."""
    parts, at = [], 0
    for kind, a, b in sorted(spans(text) if found is None else found, key=lambda x: (x[1], -x[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, counts of the base kinds, base_sha256 and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(x or "") for x in batch.column(1).to_pylist()]
            said = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
            counts = [pa.array([sum(k == kind for k, _, _ in s) for s in found], pa.int64()) for kind in BASE]
            base = [hashlib.sha256(said([x for x in s if x[0] in BASE]).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array([said(s) for s in found], pa.string())], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced; null texts stay null and other columns as they came."""

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else redacted(t))

    return docs.select(*[(clean(F.col(f"`{c}`")) if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])
