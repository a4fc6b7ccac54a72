"""One batch of consolidation: candidates, duplicates, entities, supersession, edges; the fold over batches is foreachBatch (streaming/ingest.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS, Settings
from mnemolake.durable import kept
from mnemolake.functions import scoring
from mnemolake.functions.text import entity_form, is_correction, statement_key, without_label
from mnemolake.operators import entities, linking, memory, stage2
from mnemolake.sources.store import migrated, upserted



def _texts() -> Column:
    return F.array().cast("array<string>")


def _nodes(rows: DataFrame, now: Column, embed: Callable[[Column], Column] | None) -> DataFrame:
    """Candidates as nodes of today, with what the batch needs to know of them beside."""
    return rows.select(
        "id", F.col("node_type").alias("type"), "content", (embed(F.col("content")) if embed else F.array().cast("array<float>")).alias("embedding"),
        now.alias("created_at"), now.alias("last_accessed"), F.array("session_id").alias("source_sessions"),
        F.transform("sources", lambda i: F.struct(F.col("session_id").alias("session_id"), i.cast("int").alias("message_index"))).alias("source_refs"), F.lit(1).cast("long").alias("access_count"),
        "canonical_key", F.lit("active").alias("status"), F.coalesce(F.col("valid_from").cast("timestamp"), now).alias("valid_from"), F.col("valid_to").cast("timestamp").alias("valid_to"), "confidence", "entity_type", "mentioned_dates",
        "statement", "is_correction", "session_id", "message_index", "kind_order", "began",
    )


_BESIDE = ["statement", "is_correction", "session_id", "message_index", "kind_order", "began"]


def _reinforced(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes with the references and sessions of what was found to be them: seen (node, session_id, refs, alias). One access for each session that is new to a node, so a batch done twice counts once."""
    more = seen.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("refs"))).alias("__refs"), F.array_sort(F.collect_set("session_id")).alias("__sessions"), F.array_sort(F.collect_set("alias")).alias("__aliases"))
    sessions = F.array_except(F.coalesce("__sessions", _texts()), "source_sessions")
    spelt = F.filter(F.coalesce("__aliases", _texts()), lambda a: a != without_label(F.col("content")))
    return (
        nodes.join(more, nodes.id == more.node, "left")
        .withColumns({
            "access_count": F.col("access_count") + F.size(sessions),
            "source_refs": F.array_union("source_refs", F.coalesce("__refs", F.array().cast(nodes.schema["source_refs"].dataType))),
            "aliases": F.array_union("aliases", spelt),
        })
        .withColumn("source_sessions", F.array_union("source_sessions", F.coalesce("__sessions", _texts())))
        .drop("node", "__refs", "__sessions", "__aliases")
    )


def _superseded(nodes: DataFrame, made: DataFrame, now: Column, s: Settings) -> DataFrame:
    """All nodes after the batch: those that a new statement contradicts are closed, and the new ones list them."""
    order = F.struct(F.lit(1).alias("b"), "created_at", "began", "session_id", "message_index", "kind_order")
    new = made.select("id", order.alias("ord"), F.col("canonical_key").alias("key"), "statement", "is_correction", F.col("session_id").alias("session"), F.col("message_index").alias("msg"))
    # a node is as far from a correction as its latest reference in that session
    ref = F.explode_outer("source_refs").alias("ref")
    told = nodes.where("status = 'active'").select("id", "created_at", "canonical_key", "content", ref).groupBy("id", "created_at", "canonical_key", "content", F.col("ref.session_id").alias("session")).agg(F.max("ref.message_index").alias("msg"))
    old_order = F.struct(F.lit(0).alias("b"), "created_at", F.lit(None).cast("timestamp").alias("began"), F.lit("").alias("session_id"), F.lit(0).alias("message_index"), F.lit(0).cast("long").alias("kind_order"))
    old = told.select("id", old_order.alias("ord"), F.col("canonical_key").alias("key"), statement_key(F.col("content")).alias("statement"), is_correction(F.col("content")).alias("is_correction"), "session", "msg")
    beaten = memory.superseded(old.unionByName(new), s)
    wins = beaten.groupBy("by").agg(F.array_sort(F.collect_list("id")).alias("__beat"))
    full = upserted(nodes, migrated(made.drop(*_BESIDE)))
    return (
        full.join(beaten.select(F.col("id").alias("__old")), F.col("id") == F.col("__old"), "left").join(wins, F.col("id") == F.col("by"), "left")
        .withColumns({"status": F.when(F.col("__old").isNotNull(), "superseded").otherwise(F.col("status")), "valid_to": F.when(F.col("__old").isNotNull(), now).otherwise(F.col("valid_to")), "supersedes": F.array_union("supersedes", F.coalesce("__beat", _texts()))})
        .drop("__old", "by", "__beat")
    )


def strengthened(nodes: DataFrame, now: Column, s: Settings = DEFAULTS) -> DataFrame:
    """Nodes with their strength as of now."""
    p90 = scoring.p90_of(nodes, "access_count")
    new = F.struct(scoring.recency(F.col("last_accessed"), now, s).alias("recency"), F.col("access_count").alias("frequency"), scoring.strength(F.col("last_accessed"), F.col("access_count"), now, F.col("p90"), s).alias("composite"))
    return nodes.crossJoin(F.broadcast(p90)).withColumn("strength", new).drop("p90")  # one row


def _entities(messages: DataFrame, nodes: DataFrame, now: Column, began: DataFrame, extract: entities.Extractor, embed, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """(new entity nodes, what is known of old ones, (session_id, entity, form) of all that the batch's sessions name)."""
    named = kept(entities.extracted(messages, extract).join(began, "session_id").withColumn("ord", F.struct("began", "session_id", "message_index", "position")))
    hit = entities.resolved(named.select("name", "label").distinct(), nodes, embed, s)
    both = (F.col("name") == F.col("n")) & F.col("label").eqNullSafe(F.col("l"))
    known = kept(named.join(hit.select(F.col("name").alias("n"), F.col("label").alias("l"), "entity"), both, "left"))
    old = known.where("entity IS NOT NULL")
    refs = lambda: F.array(F.struct("session_id", F.col("message_index").cast("int").alias("message_index")))
    seen = old.select(F.col("entity").alias("node"), "session_id", refs().alias("refs"), F.trim("name").alias("alias"))
    new = kept(entities.fresh(known.where("entity IS NULL").select("session_id", "ord", "name", "label")))
    first = memory.first_by(new, ["root"], ["ord"])
    # the id comes of the form, so a batch done twice gives the same node
    made = first.select(
        F.sha2(F.concat_ws("|", F.lit("entity"), "root"), 256).alias("id"), F.lit("semantic").alias("node_type"), F.concat("label", F.lit(": "), "name").alias("content"), "session_id", F.array("ord.message_index").alias("sources"),
        F.lit(None).cast("string").alias("canonical_key"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(entities.CONFIDENCE).alias("confidence"), F.col("label").alias("entity_type"), _texts().alias("mentioned_dates"),
        statement_key(F.concat("label", F.lit(": "), "name")).alias("statement"), F.lit(False).alias("is_correction"), "ord.message_index", F.lit(0).cast("long").alias("kind_order"), "ord.began",
    )
    spelt = new.join(first.select("root", F.col("ord").alias("o")), "root").where("ord != o").select(F.sha2(F.concat_ws("|", F.lit("entity"), "root"), 256).alias("node"), "session_id", F.array(F.struct("session_id", F.col("ord.message_index").cast("int").alias("message_index"))).alias("refs"), F.trim("name").alias("alias"))
    nodes_made = _reinforced(_nodes(made, now, embed).withColumn("aliases", _texts()), spelt)
    pool = old.select("session_id", "entity", entity_form(F.col("name")).alias("form")).unionByName(new.select("session_id", F.sha2(F.concat_ws("|", F.lit("entity"), "root"), 256).alias("entity"), "form")).distinct()
    # an entity is mentioned by any of its forms
    every = pool.select("session_id", "entity").distinct().join(entities.forms(nodes).select("entity", "form"), "entity").select("session_id", "entity", "form")
    return kept(nodes_made), kept(seen), kept(pool.unionByName(every).distinct())


def batch(messages: DataFrame, nodes: DataFrame, now: Column, embed: Callable[[Column], Column] | None = None, s: Settings = DEFAULTS, extract: entities.Extractor | None = None, client: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes after the batch, new edges: temporal between episodes of a session, association from statements to the entities they mention).

    `embed` is a Column function from content to vector, `extract` finds entities in a message, `client`
    answers a transcript with proposals; each may be left out. Sessions are folded in the order in which they began:
    of statements with the same content the first becomes a node, later sessions reinforce it. Candidates are compared
    with the nodes as of the batch's start, superseded ones too; a near duplicate adds its references to the
    node instead of becoming one. Ids come of the content, so a batch that is done twice changes nothing.
    """
    began = kept(messages.groupBy("session_id").agg((F.min("timestamp") if "timestamp" in messages.columns else F.min(now)).alias("began")))
    # what many branches read is written once: candidates, new nodes
    found = kept(memory.candidates(messages, now).withColumn("sources", F.array("message_index")))
    if client is not None:
        proposed = stage2.proposals(stage2.asked(stage2.chunks(messages, s), client), found, s)
        found = found.unionByName(stage2.as_candidates(proposed), allowMissingColumns=True)
    found = found.join(began, "session_id").withColumn("entity_type", F.lit(None).cast("string"))
    order = ["began", "session_id", "message_index", "kind_order"]
    found = found.withColumn("id", F.sha2(F.concat_ws("|", "session_id", F.col("message_index").cast("string"), "statement"), 256))
    found = kept(found)
    first = kept(memory.first_by(found, ["content"], order))
    again = found.join(first.select(F.col("content").alias("c"), F.col("id").alias("node"), F.col("session_id").alias("home")), F.col("content") == F.col("c")).where("id != node")
    repeats = kept(again.select("node", "session_id", F.transform("sources", lambda i: F.struct(F.col("session_id").alias("session_id"), i.cast("int").alias("message_index"))).alias("refs"), F.lit(None).cast("string").alias("alias")))
    made = _nodes(first, now, embed)
    seen = repeats.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    named = None
    if extract is not None:
        fresh, met, named = _entities(messages, nodes, now, began, extract, embed, s)
        seen, made = seen.unionByName(met), made.withColumn("aliases", _texts()).unionByName(fresh)
    else:
        made = made.withColumn("aliases", _texts())
    known = nodes.select(F.col("id").alias("__known"))
    made = made.join(known, F.col("id") == F.col("__known"), "left_anti")
    if embed:
        twins = linking.near_duplicates(made.withColumnRenamed("id", "query").select("query", "embedding"), nodes, s)
        twin = made.join(twins.select("query", "node"), made.id == F.col("query")).select("node", "session_id", F.col("source_refs").alias("refs"), F.lit(None).cast("string").alias("alias"))
        # what repeats a near duplicate in a later session is one too
        echo = repeats.join(twins.select(F.col("query").alias("node"), F.col("node").alias("to")), "node").select(F.col("to").alias("node"), "session_id", "refs", "alias")
        seen = seen.unionByName(twin).unionByName(echo)
        made = made.join(twins.select(F.col("query").alias("__q")), F.col("id") == F.col("__q"), "left_anti")
    made = kept(_reinforced(made, repeats))
    statements = made.where("entity_type IS NULL")
    after = strengthened(kept(_superseded(kept(_reinforced(nodes, seen)), made, now, s)), now, s)
    edges = memory.chained(statements.where("type = 'episodic'"), ["session_id"], ["message_index", "kind_order"], "id")
    if named is not None:
        edges = edges.unionByName(memory.mentions(statements.select("id", "session_id", "content"), named, s.mention_weight, ["session_id"]))
    return after, edges.withColumn("created_at", now)
