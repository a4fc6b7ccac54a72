"""String functions as Column expressions: tokens, three normalisers, patterns, slot keys.

White space, letters and word borders are Unicode's throughout: a pattern's `\\s`, `\\w` and leading `\\b`
are written out as classes by `spark_pattern` (and by `re2_pattern`, for engines without look-behind).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that queries and documents lose.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought "
    "used to of in for on with at by from as into through during before after above below between out off over under again further then "
    "once here there when where why how all both each few more most other some such no nor not only own same so than too very just "
    "because but and or if while about up it its i me my we our you your he him his she her they them their this that these "
    "those what which who whom"
).split()

# The patterns of each category; within one, the first listed that matches counts.
PATTERNS: dict[str, list[str]] = {
    "correction": [
        r"\bactually[,:]?\s+(.+)",
        r"\bno[,:]?\s+(?:it(?:'s| is)|that(?:'s| is))\s+(.+)",
        r"\bthat(?:'s| is) (?:wrong|incorrect|not right)[,.]?\s*(.+)",
        r"\bcorrection[:\s]+(.+)",
        r"\bI meant\s+(.+)",
    ],
    "preference": [
        r"\bI prefer\s+(.+)",
        r"\balways (?:use|do|make|keep|write)\s+(.+)",
        r"\bnever (?:use|do|make|keep|write)\s+(.+)",
        r"\bdon'?t (?:ever )?(?:use|do|make|keep|write)\s+(.+)",
        r"\bplease (?:always|never)\s+(.+)",
        r"\bI (?:like|want|need) (?:to use |to have |)\s*(.+)",
    ],
    "fact": [
        r"\bthe (?:api |)(?:endpoint|url|path|port|host|server|database|repo|repository) (?:is|runs? (?:on|at))\s+(.+)",
        r"\b(?:the|my|our)\s+(?:\w+\s+){0,3}is\s+(.+)",
        r"\b(?:it|this) (?:is|was) (?:called|named|located at)\s+(.+)",
        r"\bI (?:am|work at|work on|use|live in)\s+(.+)",
    ],
    "outcome": [
        r"\b(?:that|it) (?:worked|succeeded|passed|fixed it)",
        r"\b(?:that|it) (?:failed|didn'?t work|broke|errored)",
        r"\b(?:error|exception|traceback|failure)[:\s]+(.+)",
        r"\bsuccess(?:fully)?[:\s]+(.+)",
    ],
}
CONFIDENCE = {"correction": 0.9, "fact": 0.8, "preference": 0.75, "outcome": 0.65}
NODE_TYPE = {"correction": "semantic", "fact": "semantic", "preference": "procedural", "outcome": "episodic"}
# Prefixes, slot patterns and corporate suffixes.
CORRECTION_PREFIX = r"(?i)^(?:actually|correction|i meant|no[,:]?\s+(?:it(?:'s| is)|that(?:'s| is))|that(?:'s| is)\s+(?:wrong|incorrect|not right))\s*[,:\-]?\s*"
LIVE_IN = r"(?i)^i (?:live|am based|'m based) in\s+(.+)$"
WORK_AT = r"(?i)^i work (?:at|for)\s+(.+)$"
PREFER = r"(?i)^(?:i|we)\s+prefer\s+(?:to\s+(?:use|have)\s+)?(?:using\s+)?(.+)$"
POLICY = r"(?i)^(?:please\s+)?(?:always|never|don'?t(?:\s+ever)?|do not)\s+(use|do|make|keep|write)\s+(.+)$"
IS_SLOT = r"(?i)^(.+?)\s+(?:is|was|are|were)\s+.+$"
SUBJECT_WORDS = 8
IMPLICIT = ("preference", "policy")
SUFFIXES = "inc incorporated ltd limited llc plc corp corporation co company holdings group gmbh ag sa bv pty llp".split()
DOMAIN = r"^(?:https?://)?(?:www\.)?([a-z0-9-]+)(?:\.[a-z0-9-]+)+(?:/.*)?$"


#: The insides of character classes: white space, and what words are made of.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
EDGES = rf"^[{SPACE}]+|[{SPACE}]+$"


def _classes(pattern: str) -> str:
    out = re.sub(r"\[([^\]\\]*)\\s([^\]]*)\]", lambda m: f"[{m[1]}{SPACE}{m[2]}]", pattern)
    return out.replace(r"\s", f"[{SPACE}]").replace(r"\w", f"[{WORD}]")


def spark_pattern(pattern: str) -> str:
    """The pattern for Spark, where a dot is any character and case is ignored."""
    body = pattern.removeprefix("(?i)")
    return "(?isu)" + _classes(f"(?<![{WORD}])" + body[2:] if body.startswith(r"\b") else body)


def re2_pattern(pattern: str) -> str:
    """The same for RE2, with the match in group 1."""
    body = pattern.removeprefix("(?i)")
    return "(?is)" + _classes(f"(?:^|[^{WORD}])({body[2:]})" if body.startswith(r"\b") else f"({body})")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores without stop words, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_]+)"), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS))


def normalized(c: Column) -> Column:
    """For statements: lower case, single spaces, no punctuation at the edges."""
    return F.regexp_replace(F.regexp_replace(stripped(F.lower(c)), f"[{SPACE}]+", " "), f"^[{SPACE},.:;!?-]+|[{SPACE},.:;!?-]+$", "")


def folded(c: Column) -> Column:
    """For exact deletion: lower case and single spaces only."""
    return F.trim(F.regexp_replace(F.lower(c), f"[{SPACE}]+", " "))


def without_correction(c: Column) -> Column:
    return stripped(F.regexp_replace(c, spark_pattern(CORRECTION_PREFIX), ""))


def is_correction(c: Column) -> Column:
    return without_correction(c) != stripped(c)


def statement_key(c: Column) -> Column:
    return normalized(without_correction(normalized(c)))


def head_token(c: Column) -> Column:
    return F.try_element_at(tokens(c), F.lit(1))


def canonical_key(content: Column) -> Column:
    """The slot a statement fills, or null: live-in, work-at, prefer, policy, then `subject is`."""
    s = statement_key(content)
    live, work, like, rule, slot = map(spark_pattern, (LIVE_IN, WORK_AT, PREFER, POLICY, IS_SLOT))
    prefer, verb, thing, left = F.regexp_extract(s, like, 1), F.regexp_extract(s, rule, 1), F.regexp_extract(s, rule, 2), normalized(F.regexp_extract(s, slot, 1))
    return (
        F.when(s == "", None)
        .when(s.rlike(live), "fact:i live in")
        .when(s.rlike(work), "fact:i work at")
        .when(s.rlike(like), F.concat(F.lit("preference:"), head_token(prefer)))
        .when(s.rlike(rule), F.concat(F.lit("policy:"), F.lower(verb), F.lit(":"), head_token(thing)))
        .when(s.rlike(slot) & (left != "") & (F.size(F.split(left, r"\s+")) <= SUBJECT_WORDS), F.concat(F.lit("fact:"), left))
    )


def key_family(key: Column) -> Column:
    return F.when(key.contains(":"), F.split_part(key, F.lit(":"), F.lit(1)))


def correction_supersedes(new_key: Column, new_is_correction: Column, old_key: Column, distance: Column, window: int) -> Column:
    near = new_is_correction & (key_family(new_key) == key_family(old_key)) & key_family(new_key).isin(*IMPLICIT) & (distance > 0) & (distance <= window)
    return F.coalesce((new_key == old_key) | near, F.lit(False))


def matches(content: Column) -> Column:
    """array<struct<type, content>>: of each category, the first listed pattern's match."""
    found = []
    for kind, patterns in PATTERNS.items():
        hits = [F.when(content.rlike(p), stripped(F.regexp_extract(content, p, 0))) for p in map(spark_pattern, patterns)]
        found.append(F.struct(F.lit(kind).alias("type"), F.coalesce(*hits).alias("content")))
    return F.filter(F.array(*found), lambda x: x["content"].isNotNull())


def entity_form(c: Column) -> Column:
    """Canonical surface form: a domain's label, or words without possessive, marks and corporate suffixes."""
    low = stripped(F.lower(c))
    plain = F.regexp_replace(F.regexp_replace(low, r"'s\b", ""), r"[^a-z0-9\s-]", " ")
    kept = F.array_join(F.filter(F.split(stripped(plain), r"\s+"), lambda t: (t != "") & ~t.isin(*SUFFIXES)), " ")
    return F.when(low.rlike(DOMAIN) & ~low.contains(" "), F.replace(F.regexp_extract(low, DOMAIN, 1), F.lit("-"), F.lit(" "))).otherwise(F.when(kept != "", kept).otherwise(low))


def without_label(content: Column) -> Column:
    """`ORG: acme` -> `acme`, when the label is upper-case letters."""
    return F.when(content.rlike(r"^[A-Z]+: "), F.regexp_replace(content, r"^[A-Z]+: ", "")).otherwise(content)


def role_of(role: Column) -> Column:
    known = ("user", "assistant", "tool_call", "tool_result")
    return F.when(role.isin(*known), role).when(F.lower(role).startswith("assist"), "assistant").otherwise("user")
