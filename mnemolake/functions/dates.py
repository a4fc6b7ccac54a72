"""Date mentions, validity windows and as-of filters.

Dates are found by six surface patterns; absolute ones are resolved natively, relative ones from an
explicit `now`. Month-first order and the current year where none is written are assumed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and the surface patterns, in order.
MONTHS = "january february march april may june july august september october november december".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_M, _D = "|".join(MONTHS), "|".join(DAYS)
DATE_PATTERNS = [
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"(?i)\b(?:yesterday|today|tomorrow|last (?:week|month|year)|next (?:week|month|year))\b",
    rf"(?i)\b(?:{_D})\b",
    rf"(?i)\b(?:{_M})\s+\d{{1,2}}(?:,?\s*\d{{4}})?\b",
    rf"(?i)\b\d{{1,2}}\s+(?:{_M})(?:\s+\d{{4}})?\b",
]
# What introduces the start or end of a validity window, and how far before the date it is looked for.
FROM_MARKERS = r"(?i)\b(?:from|since|starting|as of|effective|beginning)\s*(?:on|in)?\s*$"
UNTIL_MARKERS = r"(?i)\b(?:until|till|through|up to|ending)\s*(?:on|in)?\s*$"
LOOK_BEHIND = 24


def resolved(c: Column, now: Column) -> Column:
    """The day a surface form means, or null."""
    low = F.lower(c)
    this, day = F.year(now).cast("string"), F.to_date(now)
    month = F.coalesce(*[F.when(low.rlike(rf"\b{m}\b"), F.lit(f"{i + 1:02d}")) for i, m in enumerate(MONTHS)])
    number = F.lpad(F.regexp_extract(low, r"\b(\d{1,2})\b", 1), 2, "0")
    year = F.coalesce(F.nullif(F.regexp_extract(low, r"\b(\d{4})\b", 1), F.lit("")), this)
    part = lambda k: F.regexp_extract(low, r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$", k)
    long_year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    back = F.coalesce(*[F.when(low == d, F.lit(i)) for i, d in enumerate(DAYS)])
    cast = lambda x: x.try_cast("date")
    return (
        F.when(low.rlike(r"^\d{4}-\d{2}-\d{2}$"), cast(low))
        .when(low.rlike(r"^\d{1,2}/"), cast(F.concat_ws("-", long_year, F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))))
        .when(low == "today", day).when(low == "yesterday", F.date_sub(day, 1)).when(low == "tomorrow", F.date_add(day, 1))
        .when(low == "last week", F.date_sub(day, 7)).when(low == "next week", F.date_add(day, 7))
        .when(low == "last month", F.add_months(day, -1)).when(low == "next month", F.add_months(day, 1))
        .when(low == "last year", F.add_months(day, -12)).when(low == "next year", F.add_months(day, 12))
        .when(back.isNotNull(), F.date_sub(day, F.pmod(F.weekday(day) - back, F.lit(7))))
        .when(month.isNotNull(), cast(F.concat_ws("-", year, month, number)))
    )


def mentions(text: Column, now: Column) -> Column:
    """array<struct<original, start, day>> in pattern order; the first of each surface form, resolved only."""
    found = []
    for p in DATE_PATTERNS:
        surface = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda x: F.lower(x)))
        # where the form stands by itself: not inside a longer number or word
        found.append(F.transform(surface, lambda x: F.struct(x.alias("original"), F.regexp_instr(F.lower(text), F.concat(F.lit(r"\b\Q"), x, F.lit(r"\E\b"))).alias("start"), resolved(x, now).alias("day"))))
    return F.filter(F.flatten(F.array(*found)), lambda x: x["day"].isNotNull())


def validity(text: Column, dates: Column) -> Column:
    """struct<valid_from, valid_to>: of the dates that a marker introduces, the last of each kind."""
    before = lambda d: F.substring(text, F.greatest(d["start"] - LOOK_BEHIND, F.lit(1)), F.least(d["start"] - 1, F.lit(LOOK_BEHIND)))
    begin = F.filter(dates, lambda d: before(d).rlike(FROM_MARKERS))
    end = F.filter(dates, lambda d: before(d).rlike(UNTIL_MARKERS) & ~before(d).rlike(FROM_MARKERS))
    last = lambda a: F.try_element_at(a, F.lit(-1))["day"]
    return F.struct(last(begin).alias("valid_from"), last(end).alias("valid_to"))


def valid_at(valid_from: Column, valid_to: Column, moment: Column) -> Column:
    """Half-open [from, to); null is open."""
    return (valid_from.isNull() | (valid_from <= moment)) & (valid_to.isNull() | (valid_to > moment))


def timestamp(c: Column) -> Column:
    """ISO text as an instant; without an offset it is UTC (the session's zone); junk is null."""
    return c.try_cast("timestamp")
