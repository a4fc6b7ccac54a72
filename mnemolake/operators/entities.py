"""Entities: found by a pluggable extractor, resolved to nodes, made nodes themselves, and linked to what mentions them.

Resolution goes from strict to loose: an exact normalised form; words contained one way or the
other, with the first word shared, at most two words apart and one candidate only; and, with
embeddings, the most similar node of like spelling. Labels must agree where both sides have one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS, Settings
from mnemolake.durable import kept
from mnemolake.functions import text
from mnemolake.operators import linking, memory

#: Labels that become nodes; fixed values.
LABELS = "PERSON ORG GPE LOC PRODUCT EVENT WORK_OF_ART LANGUAGE NORP FAC LAW".split()
CONFIDENCE = 0.75
#: Extra words that the longer of two contained forms may have.
EXTRA_WORDS = 2

Extractor = Callable[[str], list[tuple[str, str]]]


def gazetteer(names: dict[str, str]) -> Extractor:
    """An extractor of known names, (name -> label), as whole words, the longest first."""
    low = {n.lower(): label for n, label in names.items()}
    found = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
    return lambda said: [(m[0], low[m[0].lower()]) for m in found.finditer(said)] if names else []


def extracted(messages: DataFrame, extract: Extractor, labels: list[str] | None = None) -> DataFrame:
    """(session_id, message_index, position, name, label): in each session the first of a name, case aside, and label, of the labels that count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, i, k, *x) for s, i, c in zip(pdf.session_id, pdf.message_index, pdf.content, strict=True) for k, x in enumerate(extract(c or ""))]
            yield pd.DataFrame(rows, columns=["session_id", "message_index", "position", "name", "label"])

    some = messages.select("session_id", F.col("message_index").cast("int").alias("message_index"), "content")
    found = some.mapInPandas(run, "session_id string, message_index int, position int, name string, label string")
    return memory.first_by(found.where(F.col("label").isin(*(labels or LABELS))), ["session_id", F.lower("name"), "label"], ["message_index", "position"])


def label_of(content: Column, entity_type: Column) -> Column:
    """A node's label: its entity_type, else the capitals before a colon, else null."""
    return F.coalesce(entity_type, F.nullif(F.regexp_extract(content, r"^([A-Z]+): ", 1), F.lit("")))


def forms(nodes: DataFrame) -> DataFrame:
    """(entity, own_label, form) of the nodes that are entities, by content and aliases."""
    some = nodes.withColumn("own_label", label_of(F.col("content"), F.col("entity_type"))).where("own_label IS NOT NULL")
    surfaces = F.concat(F.array(text.without_label(F.col("content"))), F.coalesce("aliases", F.array().cast("array<string>")))
    return some.select(F.col("id").alias("entity"), "own_label", F.explode(F.transform(surfaces, text.entity_form)).alias("form")).where("form != ''").distinct()


def _fits(label: str, own: str) -> Column:
    return F.col(label).isNull() | F.col(own).isNull() | (F.col(label) == F.col(own))


def _contained(a: Column, b: Column) -> Column:
    """Words of one form all in the other, with the same first word."""
    x, y = F.split(a, " "), F.split(b, " ")
    few, many = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    return (F.size(F.array_except(few, many)) == 0) & (F.size(many) - F.size(few) <= EXTRA_WORDS)


def _first_word(form: str) -> Column:
    return F.split_part(F.col(form), F.lit(" "), F.lit(1))


def resolved(names: DataFrame, nodes: DataFrame, embed: Callable[[Column], Column] | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """(name, label, entity) of the names that a node stands for. names: name, label; each pair once."""
    # forms are worked out once, not wherever they are compared
    asked = kept(names.select("name", "label", text.entity_form(F.col("name")).alias("asked"))).where("asked != ''")
    known = kept(forms(nodes))
    exact = asked.join(known, F.col("asked") == F.col("form")).where(_fits("label", "own_label")).groupBy("name", "label").agg(F.min("entity").alias("entity"))
    left = asked.join(exact, (asked["name"] == exact["name"]) & asked["label"].eqNullSafe(exact["label"]), "left_anti")
    near = left.join(known.withColumn("word", _first_word("form")), _first_word("asked") == F.col("word")).where(_fits("label", "own_label") & _contained(F.col("asked"), F.col("form")))
    inside = near.groupBy("name", "label").agg(F.collect_set("entity").alias("all")).where(F.size("all") == 1).select("name", "label", F.get("all", 0).alias("entity"))
    found = exact.unionByName(inside)
    if embed is not None:
        rest = left.join(inside, (left["name"] == inside["name"]) & left["label"].eqNullSafe(inside["label"]), "left_anti")
        rest = rest.select(F.concat_ws("|", "label", "name").alias("query"), "name", "label", embed(F.col("name")).alias("embedding"))
        links = linking.entity_links(rest, nodes.join(known.select(F.col("entity").alias("id")).distinct(), "id", "left_semi"), s)
        found = found.unionByName(rest.join(links, "query").select("name", "label", F.col("node").alias("entity")))
    return found


def fresh(names: DataFrame) -> DataFrame:
    """(session_id, name, label, root): of names that no node stands for, the first of each form and those contained in one earlier form only. names: session_id, ord, name, label."""
    asked = kept(names.withColumn("form", text.entity_form(F.col("name")))).where("form != ''")
    roots = memory.first_by(asked, ["form", "label"], ["ord"]).select("form", "label", "ord", F.concat_ws("|", "label", "form").alias("root"))
    a = roots.select(F.col("form").alias("f"), F.col("label").alias("l"), F.col("ord").alias("o"))
    b = roots.select(F.col("form").alias("g"), F.col("label").alias("m"), F.col("ord").alias("p"), F.col("root").alias("first"))
    under = a.join(b, (_first_word("f") == _first_word("g")) & (F.col("p") < F.col("o"))).where(_fits("l", "m") & _contained(F.col("f"), F.col("g")))
    under = under.groupBy("f", "l").agg(F.collect_set("first").alias("all")).where(F.size("all") == 1).select("f", "l", F.get("all", 0).alias("first"))
    to = roots.join(under, (F.col("form") == F.col("f")) & F.col("label").eqNullSafe(F.col("l")), "left").select(F.col("form").alias("own"), F.col("label").alias("kind"), F.coalesce("first", "root").alias("root"))
    return asked.join(to, (F.col("form") == F.col("own")) & F.col("label").eqNullSafe(F.col("kind"))).select("session_id", "ord", "name", "label", "form", "root")
