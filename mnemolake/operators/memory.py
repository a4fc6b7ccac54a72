"""Statements to slots: extraction, first occurrences, supersession, chains and one-hop expansion, all as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS, Settings
from mnemolake.durable import kept
from mnemolake.functions import dates, text

#: Phrases that `mentions` may broadcast; above it they are joined by shuffle.
BROADCAST_FORMS = 200_000
#: Slots of hashes of phrases, of which those that some phrase has are broadcast to keep most other runs from the shuffle.
FORM_SLOTS = 1 << 20


def extracted(messages: DataFrame, roles: tuple[str, ...] | None = None) -> DataFrame:
    """(session_id, message_index, type, content) from messages; `roles` narrows to those (the buffer takes user and tool_result)."""
    some = messages.where(F.col("role").isin(*roles)) if roles else messages
    return some.select("session_id", "message_index", F.explode(text.matches(F.col("content"))).alias("m")).select("session_id", "message_index", "m.type", "m.content")


def first_by(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def candidates(messages: DataFrame, now: Column) -> DataFrame:
    """Extractions with slot, confidence and validity: the first per type and 100-character prefix, then per statement, in each session."""
    order = ["message_index", "kind_order"]
    kinds = list(text.PATTERNS)
    found = extracted(messages).withColumn("kind_order", F.array_position(F.array(*map(F.lit, kinds)), F.col("type")))
    once = first_by(found, ["session_id", "type", F.substring("content", 1, 100)], order)
    keyed = once.withColumns({"statement": text.statement_key(F.col("content")), "canonical_key": text.canonical_key(F.col("content")), "is_correction": text.is_correction(F.col("content"))})
    stated = first_by(keyed, ["session_id", "statement"], order)
    said = messages.select("session_id", "message_index", F.col("content").alias("said")).withColumn("dates", dates.mentions(F.col("said"), now))
    # a day that an earlier message of the session named is not named again
    days = said.select("session_id", "message_index", F.posexplode("dates").alias("place", "d"))
    days = first_by(days, ["session_id", "d.day"], ["message_index", "place"]).groupBy("session_id", "message_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "d"))), lambda x: x["d"]).alias("dates"))
    said = said.drop("dates").join(days, ["session_id", "message_index"], "left").withColumn("dates", F.coalesce("dates", F.array().cast(days.schema["dates"].dataType)))
    by = lambda m: F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in m.items()])
    return (
        stated.join(said, ["session_id", "message_index"], "left")
        .withColumn("window", dates.validity(F.col("said"), F.col("dates")))
        .select("session_id", "message_index", "kind_order", "type", "content", "statement", "canonical_key", "is_correction", by(text.NODE_TYPE).alias("node_type"), by(text.CONFIDENCE).alias("confidence"), "window.valid_from", "window.valid_to", F.coalesce(F.transform("dates", lambda d: d["day"].cast("string")), F.array().cast("array<string>")).alias("mentioned_dates"))
    )


def superseded(statements: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """For committed statements (id, ord, key, statement, is_correction, session, msg): (id, by), the earliest later one that contradicts it.

    Two equi-joins, never a cross join: on the key, where runs of one statement are collapsed and the next
    other statement is the next run; and on (session, family) with a message range, for corrections of implicit slots.
    """
    w = Window.partitionBy("key").orderBy("ord")
    runs = statements.where("key IS NOT NULL").withColumn("turn", F.when(F.lag("statement").over(w).eqNullSafe(F.col("statement")), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    heads = runs.where("turn = 1").select("key", (F.col("run") - 1).alias("run"), F.struct("ord", "id").alias("m"))
    same = runs.join(heads, ["key", "run"]).select("id", "m")
    family = text.key_family(F.col("key"))
    implicit = statements.where(family.isin(*text.IMPLICIT)).withColumn("family", family)
    new = implicit.where("is_correction").select("session", "family", F.col("ord").alias("o2"), F.col("id").alias("i2"), F.col("msg").alias("m2"), F.col("statement").alias("s2"))
    step = s.correction_window + 1  # messages in slots of that width: a partner is in the same or the next slot
    old = implicit.withColumn("slot", F.explode(F.array(F.floor(F.col("msg") / step), F.floor(F.col("msg") / step) + 1)))
    near = (
        old.join(new.withColumn("slot", F.floor(F.col("m2") / step)), ["session", "family", "slot"])
        .where((F.col("o2") > F.col("ord")) & (F.col("s2") != F.col("statement")) & (F.col("m2") - F.col("msg")).between(1, s.correction_window))
        .select("id", F.struct(F.col("o2").alias("ord"), F.col("i2").alias("id")).alias("m"))
    )
    return same.unionByName(near).groupBy("id").agg(F.min("m").alias("m")).select("id", F.col("m.id").alias("by"), F.col("m.ord").alias("by_ord"))


def chained(nodes: DataFrame, part: list[str], order: list[str], id_col: str) -> DataFrame:
    """Temporal edges (source, target, weight 1) between consecutive nodes."""
    w = Window.partitionBy(*part).orderBy(*order)
    return nodes.select(F.lag(id_col).over(w).alias("source"), F.col(id_col).alias("target")).where("source IS NOT NULL").select("source", "target", F.lit("temporal").alias("type"), F.lit(1.0).alias("weight"))


def expanded(anchors: DataFrame, edges: DataFrame, decay: float) -> DataFrame:
    """(query, node, association): one-hop neighbours of a query's anchors, either direction, the strongest edge counts."""
    ways = F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("node")), F.struct(F.col("target").alias("a"), F.col("source").alias("node")))
    both = edges.select(F.explode(ways).alias("w"), "weight").select("w.a", "w.node", "weight")
    reach = anchors.select("query", F.col("node").alias("a")).join(both, "a").groupBy("query", "node").agg(F.max(F.greatest("weight", F.lit(0.0)) * decay).alias("association")).where("association > 0")
    return reach.join(anchors.select("query", "node"), ["query", "node"], "left_anti")


def mentions(statements: DataFrame, forms: DataFrame, weight: float, within: list[str] | None = None, broadcast: int = BROADCAST_FORMS) -> DataFrame:
    """Association edges (statement, entity) where a statement's tokens hold an entity's as a phrase.

    A statement's runs of tokens, as long as phrases are, meet the phrases by equality; its text goes nowhere. Up to
    `broadcast` phrases go to the statements, and only what is found is dealt; more are joined by shuffle, where
    only runs are dealt whose hash falls in a slot of some phrase's. One-token phrases of under three characters are
    skipped. `within` names columns that both sides must share.
    """
    also = within or []
    named = forms.select("entity", *also, text.tokens(F.col("form")).alias("p")).where((F.size("p") > 1) | (F.length(F.get("p", 0)) >= 3))
    named = kept(named.select("entity", *also, F.size("p").alias("n"), F.array_join("p", " ").alias("phrase")).distinct())
    lengths = named.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy("n").collect()  # a row for each length that phrases have
    t = statements.select("id", *also, text.tokens(F.col("content")).alias("t"))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.array_join(F.slice("t", i, n), " "))
    runs = [F.filter("t", lambda x: F.length(x) >= 3) if n == 1 else F.when(F.size("t") >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in (r.n for r in lengths)]
    # not explode: Spark would work the runs out a second time, to see whether there are any
    said = t.select("id", *also, F.explode_outer(F.array_distinct(F.concat(*runs, F.array().cast("array<string>")))).alias("phrase"))
    named = named.drop("n")
    if sum(r.k for r in lengths) <= broadcast:
        named = F.broadcast(named)
    else:
        slot = F.pmod(F.xxhash64("phrase"), F.lit(FORM_SLOTS)).alias("slot")
        said = said.where("phrase IS NOT NULL").withColumn("slot", slot).join(F.broadcast(named.select(slot).distinct()), "slot", "left_semi").drop("slot")
    found = said.join(named, ["phrase", *also])
    return found.select(F.col("id").alias("source"), F.col("entity").alias("target"), F.lit("association").alias("type"), F.lit(weight).alias("weight")).distinct()


def alias_index(nodes: DataFrame) -> DataFrame:
    """(form, ids) from entity nodes (id, content, aliases)."""
    forms = nodes.select("id", F.explode(F.concat(F.array(text.without_label(F.col("content"))), F.coalesce("aliases", F.array().cast("array<string>")))).alias("surface"))
    return forms.select("id", text.entity_form(F.col("surface")).alias("form")).where("form != ''").groupBy("form").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def resolved(names: DataFrame, index: DataFrame) -> DataFrame:
    """(name, node): exact form with one owner, else the one node whose form contains or is contained in the name's words."""
    asked = names.select("name", text.entity_form(F.col("name")).alias("form"))
    exact = asked.join(index, "form", "left").select("name", "form", F.when(F.size("ids") == 1, F.get("ids", 0)).alias("node"))
    open_ = exact.where("node IS NULL").withColumn("a", F.array_distinct(F.split("form", " ")))
    pool = index.select(F.explode("ids").alias("id"), F.array_distinct(F.split("form", " ")).alias("b"))
    joined = open_.withColumn("w", F.explode("a")).join(pool.withColumn("w", F.explode("b")), "w").select("name", "a", "b", "id").distinct()
    inside = (F.size(F.array_except("a", "b")) == 0) | (F.size(F.array_except("b", "a")) == 0)
    by_words = joined.where(inside & (F.abs(F.size("a") - F.size("b")) <= 2)).groupBy("name").agg(F.collect_set("id").alias("c")).where(F.size("c") == 1).select("name", F.get("c", 0).alias("second"))
    return exact.join(by_words, "name", "left").select("name", F.coalesce("node", "second").alias("node"))
