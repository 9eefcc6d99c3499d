"""Categories, keyword votes, topics and mood as column expressions."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodtide.functions import lexicon
from moodtide.schemas import COLOR_THRESHOLD, SCORE_THRESHOLD

_MARKS = ".,!?;:"


def _hits(text: Column, words: list[str]) -> Column:
    """Number of entries that the text contains as substrings; an entry listed k times adds k.

    Entries are grouped by how often they are listed, so each distinct word is searched once.
    """
    by_weight: dict[int, list[str]] = {}
    for w, n in Counter(words).items():
        by_weight.setdefault(n, []).append(w)
    total = F.lit(0)
    for n, ws in sorted(by_weight.items()):
        total = total + F.lit(n) * F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(text, w)))
    return total


def keyword_votes(text: Column) -> tuple[Column, Column]:
    """Positive and negative entries of a text. The lower-cased text is bound once a row, not once a word."""
    both = F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda low: F.struct(_hits(low, lexicon.POSITIVE_WORDS).alias("pos"), _hits(low, lexicon.NEGATIVE_WORDS).alias("neg"))), F.lit(0))
    return both["pos"], both["neg"]


def keyword_sentiment(text: Column) -> Column:
    low = F.array(F.lower(F.coalesce(text, F.lit(""))))
    return F.get(F.transform(low, lambda t: category_of(_hits(t, lexicon.POSITIVE_WORDS), _hits(t, lexicon.NEGATIVE_WORDS))), F.lit(0))


def category_of(pos: Column, neg: Column) -> Column:
    return F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")


def score_category(score: Column, threshold: float = SCORE_THRESHOLD) -> Column:
    return F.when(score >= threshold, "positive").when(score <= -threshold, "negative").otherwise("neutral")


def combined_category(score: Column, text: Column) -> Column:
    """The score's category, or the keyword vote where that is neutral."""
    own = score_category(score)
    return F.when(own == "neutral", keyword_sentiment(text)).otherwise(own)


def topics(text: Column) -> Column:
    """Hashtags, each followed by its topic, then topics of plain tokens; first occurrences only."""
    names = F.create_map(*[F.lit(x) for pair in lexicon.TOPICS.items() for x in pair])
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")

    def named(word: Column) -> Column:
        return F.element_at(names, F.rtrim(word, F.lit(_MARKS)))

    tags = F.flatten(F.transform(F.filter(tokens, lambda w: w.startswith("#")), lambda w: F.array(w, named(F.ltrim(w, F.lit("#"))))))
    plain = F.transform(tokens, named)
    return F.array_distinct(F.filter(F.concat(tags, plain), lambda w: w.isNotNull()))


def mood_index(percent: Column) -> Column:
    x = (F.greatest(F.lit(-100.0), F.least(F.lit(100.0), percent)) + 100) / 200
    low = (x * 100 * 1.2).cast("int")
    high = (70 + ((x - 0.7) / 0.3) * 29).cast("int")
    middle = (30 + F.pow((x - 0.3) / 0.4, F.lit(1.5)) * 39).cast("int")
    index = F.when(x < 0.3, low).when(x > 0.7, high).otherwise(middle)
    return F.greatest(F.lit(0), F.least(F.lit(99), index))


def mood_word(percent: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, lexicon.MOOD_WORDS)), mood_index(percent) + 1)


def sentiment_symbol(category: Column) -> Column:
    return F.when(category == "positive", "+").when(category == "negative", "-").otherwise("x")


def series_color(percent: Column, threshold: float = COLOR_THRESHOLD) -> Column:
    return F.when(percent > threshold, "positive").when(percent < -threshold, "negative").otherwise("neutral")


def stored_compound(category: Column, percent: Column) -> Column:
    """The compound that older rows hold; its negative branch is kept as it was written."""
    return F.when(category == "positive", 0.5 + percent / 200).when(category == "negative", -0.5 - percent / 200).otherwise(percent / 100)
