"""Column expressions on headlines, formatted cells and report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_pattern(words: list[str]) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


def tone(title: Column, positive: list[str], negative: list[str]) -> Column:
    """Sign of positive less negative words."""
    n = lambda words: F.regexp_count(title, F.lit(word_pattern(words)))
    return F.signum((n(positive) - n(negative)).cast("double")).cast("int")


def relevant(title: Column, tokens: list[str], noise: list[str]) -> Column:
    low = F.lower(title)
    has = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w))
    return has(tokens) & ~has(noise)


def themes(title: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text matches."""
    return F.filter(F.array(*[F.when(title.rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())


def number(cell: Column) -> Column:
    """The number of a formatted cell like +3.2%, $1,200 or -4; null without one. Percentages stay in percent."""
    return F.regexp_replace(cell, r"[$,%x\s]", "").try_cast("double")


def signal_label(signals: Column, low: int = -2, high: int = 2) -> Column:
    """negative, mixed or positive by the sum of an array of +1 and -1."""
    total = F.aggregate(signals, F.lit(0), lambda a, x: a + x)
    return F.when(total <= low, "negative").when(total >= high, "positive").otherwise("mixed")


def flags(of: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in of.items()]), lambda x: x.isNotNull())


def sentences(text: Column, limit: int) -> Column:
    """Whole sentences of up to limit characters; at least the start of the first."""
    cut = F.regexp_extract(F.substring(text, 1, limit), r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(text) <= limit, text).when(cut != "", cut).otherwise(F.substring(text, 1, limit))
