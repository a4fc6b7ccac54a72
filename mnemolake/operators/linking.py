"""Similarity links between texts and nodes: near duplicates and entities."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mnemolake.config import DEFAULTS, Settings
from mnemolake.functions.text import without_label
from mnemolake.operators import memory, vectors

STRING_LEAST = 0.3


def duplicate_pairs(candidates: DataFrame, nodes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query, node, sim): every pair at the duplicate threshold or above, a row's pair with itself too if it is on both sides."""
    return vectors.similar(candidates, nodes, "query", "id", "embedding", s.dedup_threshold)


def near_duplicates(candidates: DataFrame, nodes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query, node, sim): each candidate's nearest node, of any status, at the duplicate threshold or above."""
    return vectors.nearest(duplicate_pairs(candidates, nodes, s))


@F.pandas_udf(DoubleType())
def string_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of the lower-cased texts; Spark has no equivalent."""
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)])


def entity_links(names: DataFrame, nodes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query, node, sim): of the nodes at the link threshold, best first, the first of a compatible label and like enough spelling. names: query, name, label, embedding."""
    near = vectors.similar(names, nodes, "query", "id", "embedding", s.link_threshold)
    both = near.join(names.select("query", "name", "label"), "query").join(nodes.select(F.col("id").alias("node"), "content", "entity_type"), "node")
    fits = both.where(F.col("label").isNull() | F.col("entity_type").isNull() | (F.col("label") == F.col("entity_type")))
    like = fits.where(string_similarity("name", without_label(F.col("content"))) >= STRING_LEAST)
    return memory.first_by(like, ["query"], [F.col("sim").desc(), "node"]).select("query", "node", "sim")
