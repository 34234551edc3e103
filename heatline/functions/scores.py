"""Score expressions. as_of is a timestamp column or literal; dates are DATE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, places: int = 0) -> Column:
    """Half to even."""
    return F.bround(c, places)


def buzz(url: Column) -> Column:
    """A steady number in [0, 1) from a URL; 0.5 without one."""
    part = F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long") % 1000
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit(0.5)).otherwise(part / 1000.0)


def age_hours(published: Column, as_of: Column) -> Column:
    """Hours since midnight of the day; no day or one ahead counts as new."""
    gone = (F.unix_timestamp(as_of) - F.unix_timestamp(published.cast("timestamp"))) / 3600.0
    return F.greatest(F.lit(0.0), F.coalesce(gone, F.lit(0.0)))


def decay(age: Column, gravity: float = 1.5) -> Column:
    return 1.0 / F.pow(age + 2, F.lit(gravity))


def community(hn: Column, reddit: Column, comments: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(hn) * 10 + zero(reddit) + zero(comments) * 0.5


def heat(signal: Column, age: Column, weight: Column, noise: Column) -> Column:
    """Accumulated heat: the decayed signal, or without one the source's weight, slowly decayed, with noise."""
    recency = 1.0 / (F.log(age / 24.0 + 1) + 1)
    return rounded(F.when(signal >= 1, signal * decay(age)).otherwise(weight * recency * (0.3 + 0.7 * noise) * 100) * 100).cast("long")


def momentum(signal: Column, age: Column, weight: Column, noise: Column) -> Column:
    """Rising score: steeper decay and a boost for two days, noise the other way round."""
    days = age / 24.0
    boost = F.when(age <= 24, 1.6).when(age <= 48, 1.2).otherwise(1.0)
    quiet = weight / (F.log(days + 1) + 1) * (1 + 1.5 * F.exp(-days / 3.0)) * (1 - 0.7 * noise) * 1000
    return rounded(F.when(signal >= 1, signal * decay(age, 2.2) * boost).otherwise(quiet) * 100).cast("long")


def source_weight(region: Column, source: Column, home: str, weights: dict[str, int], home_default: int = 30, away: int = 25) -> Column:
    """Base weight of a source without community signal; a map literal of few entries."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.create_map().cast("map<string,int>")
    return F.when(region == home, F.coalesce(F.try_element_at(table, source), F.lit(home_default))).otherwise(F.lit(away))


def recency_weight(published: Column, today: Column) -> Column:
    days = F.greatest(F.lit(0), F.datediff(today, published))
    return F.when(days <= 1, 3.0).when(days <= 3, 1.5).otherwise(1.0)


def rise(current: Column, previous: Column) -> Column:
    """Growth against the previous cycle, ln(1 + n) the first time; within [-1, 10], four decimals."""
    grown = (current - previous) / F.greatest(previous.cast("double"), F.lit(0.5))
    first = F.when(current > 0, F.log(1.0 + current)).otherwise(0.0)
    return rounded(F.greatest(F.lit(-1.0), F.least(F.lit(10.0), F.when(previous.isNull(), first).otherwise(grown))), 4)


def shown_rise(value: Column) -> Column:
    """-1 says that nothing was going on, and isn't shown."""
    return F.when(value > -0.999, value)


def novelty(age_days: Column, mentions: Column) -> Column:
    fresh = F.when(age_days <= 2, 2.0).otherwise(F.exp(-age_days / 10.0))
    return rounded(fresh / (1.0 + F.log(1.0 + mentions)), 4)


def first_seen(stored: Column, days: Column, earliest: Column, now: Column) -> Column:
    """When a term was first seen: the stored day if a card still has it, else the earliest card; now without either."""
    kept = F.when(F.array_contains(days, stored.cast("date")), stored)
    early = earliest.cast("timestamp")
    return F.coalesce(F.when(early.isNotNull() & (kept.isNull() | (early < F.date_trunc("day", kept))), early).otherwise(kept), now)


def number(c: Column) -> Column:
    """A sort key: text, null, NaN and infinities are 0."""
    value = c.try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


# What a hit in a field weighs in search.
FIELD_WEIGHTS = {"title": 25, "title_zh": 30, "title_en": 30, "term": 30, "display_zh": 30, "summary": 12, "summary_zh": 12, "summary_en": 12, "source": 8, "author": 8}


def words_in(words: Column, text: Column) -> Column:
    """How many of the words are substrings of a text that is lower-cased already."""
    return F.size(F.filter(words, lambda w: text.contains(w)))


def relevance(n: Column, fields: dict[str, tuple[Column, Column]], hot: Column) -> tuple[Column, Column]:
    """(score, fields hit) of a card for a query of n words: weight by share of words hit, less for long fields, heat as a
    tie-break. fields: text and number of words in it (words_in) by name."""
    parts = [F.lit(FIELD_WEIGHTS.get(k, 5)) * (hits / n) * F.when(F.length(c) < 80, 1.0).otherwise(0.8) for k, (c, hits) in fields.items()]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    names = F.array_compact(F.array(*(F.when(hits > 0, F.lit(k)) for k, (_, hits) in fields.items())))
    score = rounded(total + F.log(F.greatest(F.coalesce(hot, F.lit(0)), F.lit(0)).cast("long") + 1) * 1.5, 2)
    return F.when((n > 0) & F.greatest(F.lit(0), F.lit(0), *(hits for _, hits in fields.values())).cast("boolean"), score), names
