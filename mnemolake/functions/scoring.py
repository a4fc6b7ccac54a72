"""Strength, ranking and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS, Settings


def age_hours(then: Column, now: Column) -> Column:
    return F.greatest((F.unix_micros(now) - F.unix_micros(then)) / 3.6e9, F.lit(0.0))


def recency(then: Column, now: Column, s: Settings = DEFAULTS) -> Column:
    return F.pow(1 + s.beta * age_hours(then, now), F.lit(-s.alpha))


def p90_of(df, counts: str):  # noqa: ANN001, ANN201
    """One row (p90): the element at floor(0.9 n) of the sorted counts, 1 at least (not percentile_disc), from a histogram of values, for tables of any length."""
    tally = df.where(F.col(counts).isNotNull()).groupBy(F.col(counts).alias("value")).agg(F.count(F.lit(1)).alias("k"))
    total = tally.agg(F.sum("k").alias("n"), F.array_sort(F.collect_list(F.struct("value", "k"))).alias("h"))
    place = F.least(F.floor(F.col("n") * F.lit(0.9)), F.col("n") - 1)
    walked = F.aggregate(
        "h",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("at")),
        lambda a, x: F.struct((a["seen"] + x["k"]).alias("seen"), F.when(a["at"].isNull() & (a["seen"] + x["k"] > place), x["value"].cast("double")).otherwise(a["at"]).alias("at")),
        lambda a: a["at"],
    )
    return total.select(F.greatest(F.coalesce(walked, F.lit(1.0)), F.lit(1.0)).alias("p90"))


def frequency(count: Column, p90_value: Column) -> Column:
    return F.least(count / p90_value, F.lit(1.0))


def strength(then: Column, count: Column, now: Column, p90_value: Column, s: Settings = DEFAULTS) -> Column:
    return s.w_recency * recency(then, now, s) + s.w_frequency * frequency(count, p90_value)


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def blended(semantic: Column, lexical: Column, strength_: Column, confidence: Column, association: Column, status_bonus: Column, s: Settings = DEFAULTS) -> Column:
    plus = lambda c: F.greatest(c, F.lit(0.0))
    base = s.w_semantic * plus(semantic) + s.w_lexical * plus(lexical) + s.w_strength * plus(strength_) + s.w_confidence * plus(confidence) + s.w_association * plus(association)
    return plus(base - (1 - clamp(status_bonus)) * s.contradiction_penalty)


def rank_score(similarity: Column, strength_: Column, s: Settings = DEFAULTS) -> Column:
    zero = F.lit(0.0)
    return F.when(similarity <= 0, 0.0).otherwise(blended(similarity, zero, strength_, F.lit(0.6), zero, F.lit(1.0), s))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-8))
    return F.transform(a, lambda x: x / n)


def ndcg(rank: Column) -> Column:
    """1 / log2(rank + 1) of the first relevant result; 0 without one."""
    return F.coalesce(1 / F.log2(rank + 1), F.lit(0.0))
