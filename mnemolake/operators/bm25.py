"""BM25 over a table of texts, for a batch of queries at once.

N counts documents without tokens too, repeated query terms count repeatedly. The texts are read
once for a batch; see `scores`. `postings`, `stats` and `idf` are the whole index as tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS, Settings
from mnemolake.durable import kept
from mnemolake.functions.text import tokens


def tokenized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("tokens"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = tokenized(docs, id_col, text_col).withColumn("length", F.size("tokens"))
    return t.select("doc", "length", F.explode("tokens").alias("term")).groupBy("doc", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: n, avgdl."""
    return tokenized(docs, id_col, text_col).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("tokens")) / F.count(F.lit(1)), F.lit(0.0)).alias("avgdl"))


def idf(post: DataFrame, stat: DataFrame) -> DataFrame:
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(stat)).select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # stat has one row


def hits(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, length, some) of every document, by one pass over the texts: its length, and its tokens that are asked for. Written once, for all that is read from it."""
    wanted = [r.term for r in asked.select("term").distinct().collect()]  # the terms of a batch of questions
    each = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("tokens"))
    return kept(each.select("doc", F.size("tokens").alias("length"), F.filter("tokens", lambda t: t.isin(wanted)).alias("some")))


def scores(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, qid: str, qtext: str, s: Settings = DEFAULTS) -> DataFrame:
    """(query, doc, score) of every pair with a score above 0.

    The texts are read once, and a document's asked tokens are dealt once. The terms asked for, with weights, are
    broadcast: they are those of one batch of questions.
    """
    asked = kept(queries.select(F.col(qid).alias("query"), F.explode(tokens(F.col(qtext))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times")))
    held = hits(docs, asked, id_col, text_col)
    n, total = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    # dealt by document before its tokens are spread: neither their counts nor the scores are dealt again
    post = held.repartition("doc").select("doc", "length", F.explode_outer("some").alias("term")).where("term IS NOT NULL").groupBy("doc", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    # a document counts once for each of its terms: told by its row alone, summed per task before anything is dealt
    df = held.select(F.explode_outer(F.array_distinct("some")).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = asked.join(df, "term").select("query", "term", (F.col("times") * F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))
    length = F.col("length") / F.lit(total / n) if total else F.lit(0.0)
    part = F.col("weight") * (F.col("tf") * (s.k1 + 1)) / (F.col("tf") + s.k1 * (1 - s.b + s.b * length))
    return post.join(F.broadcast(weighed), "term").groupBy("query", "doc").agg(F.sum(part).alias("score")).where("score > 0")


def top(scored: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank): ties in document order."""
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, qid: str, qtext: str, k: int, s: Settings = DEFAULTS) -> DataFrame:
    return top(scores(docs, queries, id_col, text_col, qid, qtext, s), k)


def anchors(hits: DataFrame, ratio: float) -> DataFrame:
    """(query, doc, lexical): hits within `ratio` of the query's best."""
    w = Window.partitionBy("query")
    return hits.withColumn("lexical", F.col("score") / F.max("score").over(w)).where(F.col("lexical") >= ratio).select("query", "doc", "lexical")
