"""Quality rules: a table of thresholds compiled into one Spark projection, with no user functions.

Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words and fail. Repeated rows
are judged alike, each for itself; ties cannot arise, since no row is compared with another.
Columns besides id and text are not read; the filter keeps them all, whatever their names. A very
long text is measured whole, in one row's memory. An empty table gives no rows.

A word is *repeated* when a window of five words that holds it occurs twice or more in the
text. Whether four words in a row may repeat is first asked of hashes, which can only say yes
too often; texts where two agree have their windows of five compared as strings, so the
count is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Frequent function words of the corpus' languages (en, de, fr, es); fixed values.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at from or an not have has had but they which you "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de un une et est que dans qui pour pas sur au il elle ce du par plus ne se "
    "el los las en que con por una su para es lo como al del se y"
).split()

#: name, ratio as SQL over the measures, least and most allowed (None: open). Change the table, not the code.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("word_length", "word_chars / n_words", 1.5, 14.0),
    ("symbols", "n_symbols / n_words", None, 0.25),
    ("exclamation", "n_exclaim / n_words", None, 0.35),
    ("upper_case", "n_upper / word_chars", None, 0.6),
    ("stop_words", "n_stop / n_words", 0.02, None),
    ("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
]


def verdict(rules: list[tuple[str, str, float | None, float | None]] = RULES) -> Column:
    """True where every rule holds; false for a text without words."""
    held = F.lit(True)
    for _, ratio, least, most in rules:
        value = F.expr(ratio)
        if least is not None:
            held = held & (value >= least)
        if most is not None:
            held = held & (value <= most)
    return F.when(F.col("n_words") > 0, held).otherwise(False)  # no ratio is formed without words


def measures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` and the measures that base rules and table use."""
    keep = keep or []
    words = F.col("__words")
    n = F.size(words)
    named = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(WINDOW)), " ").alias("s"), i.alias("i")))
    p, text = F.col("__p"), F.col("__text")
    at = F.transform(
        F.sequence(F.lit(1), F.size(p)),
        lambda j: F.when((F.get(p, j - 2)["s"] == F.get(p, j - 1)["s"]) | (F.get(p, j)["s"] == F.get(p, j - 1)["s"]), F.get(p, j - 1)["i"]).otherwise(F.lit(-1)),
    )
    hits = F.array_sort(F.filter(at, lambda x: x >= 0))
    covered = F.aggregate(
        hits,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
        lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(WINDOW), x - a["last"])).alias("total")),
        lambda a: a["total"],
    )
    return (
        docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
        .withColumn("__words", F.array_remove(F.split(text, SPACE + "+"), ""))
        .withColumns({
            "__w1": F.transform(words, lambda w: F.xxhash64(w)),
            "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "__chars": F.array_join(words, ""),
        })
        .withColumn("__w2", F.zip_with("__w1", F.slice("__w1", F.lit(2), n), lambda a, b: a.bitwiseXOR(F.shiftleft(b, 1))))
        .withColumn("__w4", F.slice(F.zip_with("__w2", F.slice("__w2", F.lit(3), n), lambda a, b: a.bitwiseXOR(F.shiftleft(b, 3))), F.lit(1), F.greatest(n - 3, F.lit(0))))
        .withColumn("__p", F.when((n > WINDOW) & (F.size("__w4") > F.size(F.array_distinct("__w4"))), F.sort_array(named)))
        .select(
            *keep,
            n.cast("long").alias("n_words"),
            F.length("__chars").cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.when(p.isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("__lines").cast("long").alias("n_lines"),
            F.regexp_count("__chars", F.lit("!")).cast("long").alias("n_exclaim"),
            F.regexp_count("__chars", F.lit("[A-Z]")).cast("long").alias("n_upper"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop"),
        )
    )


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, str, float | None, float | None]] = RULES) -> DataFrame:
    """One row for each document: id, measures, base_failed and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        measures(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t", ["__id"])
        .withColumn("base_failed", base)
        .select(
            F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & verdict(rules)).alias("kept"), "n_lines", "n_exclaim", "n_upper", "n_stop",
        )
    )


def kept_documents(docs: DataFrame, text_col: str = "text", rules: list[tuple[str, str, float | None, float | None]] = RULES) -> DataFrame:
    """The documents that pass, with all their columns as they came."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(text_col).alias("__t"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # a filter would be pushed below the measures, each then worked out wherever it is named; it stays above a column that is not deterministic
    marked = measures(row, "__t", ["__row"]).select("__row", (~base & verdict(rules)).alias("__kept"), F.monotonically_increasing_id().alias("__mark"))
    return marked.where("__kept AND __mark >= 0").select(*[F.col("__row")[c].alias(c) for c in names])
