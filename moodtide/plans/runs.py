"""The three composed plans: the half-hourly run, the daily roll-up, and the charts' rows. Lazy; sinks are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.functions import sentiment as S
from moodtide.functions import text as T
from moodtide.operators import posts as O
from moodtide.operators import series as Q
from moodtide.schemas import HISTORY_TTL_DAYS, TOP_N

#: First sentences of descriptions, and the descriptions of charts of fewer than two points.
WEEKLY_SHORT = "Seven day sentiment trend chart showing community mood over time"
YEARLY_SHORT = "Yearly sentiment trend chart showing community mood over the past year"
WEEKLY_TITLE = "Seven day Bluesky sentiment trend chart. "
YEARLY_TITLE = "Yearly Bluesky sentiment trend chart showing daily averages over the past year. "


def half_hour_run(posts: DataFrame, run_id: str, cutoff: Column, now: Column, score: Column, n: int = TOP_N) -> dict[str, DataFrame]:
    """Filter, dedup, score, aggregate and rank. Categories and topics are computed for ``scored``, if that is read, and for the n top rows alone."""
    clean = O.dedup_by_uri(O.since(O.invalidated(posts), cutoff))
    scored = O.scored(clean, score)
    valued = clean.withColumn("sentiment_score", score)
    overall, top = O.overall_sentiment(valued), O.scored(O.top_posts(valued, n), F.col("sentiment_score"))
    line = F.struct("rank", F.concat(F.lit("@"), F.col("author"), F.lit(" "), S.sentiment_symbol(F.col("sentiment"))).alias("line"))
    lines = top.agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]).alias("lines"))  # n rows
    both = overall.crossJoin(lines)  # one row each
    summary = both.select(T.summary(S.mood_word(F.col("net_percent")), F.col("net_percent"), F.col("lines")).alias("text"), O.should_publish(F.col("total_posts"), F.size("lines"), F.col("overall_sentiment")).alias("should_publish"))
    point = overall.select(
        F.lit(run_id).alias("run_id"), now.alias("timestamp"), F.col("average_compound").alias("average_compound_score"), F.col("net_percent").alias("net_sentiment_percent"), F.col("overall_sentiment").alias("sentiment_category"),
        "total_posts", now.alias("created_at"), (F.unix_timestamp(now) + HISTORY_TTL_DAYS * 86400).alias("ttl"),
    )
    return {"scored": scored, "overall": overall, "top": top, "summary": summary, "history": point}


def daily_update(history: DataFrame, stored: DataFrame, compat: bool = False) -> DataFrame:
    """Roll-ups of all days that are not stored yet."""
    return Q.new_days(Q.daily_rollup(history, compat), stored)


def weekly_payload(history: DataFrame) -> DataFrame:
    """The weekly chart's description and note."""
    stats = Q.series_stats(history)
    text = T.alt_text(WEEKLY_TITLE, "Average sentiment: ", "MMM d, h:mm a 'UTC'", "period", WEEKLY_SHORT)
    note = Q.latest_is_extreme(history).select(Q.extreme_note(F.col("extreme")).alias("note"))
    return stats.select(text.alias("alt_text"), "points").crossJoin(note)  # one row each


def yearly_payload(series: DataFrame) -> DataFrame:
    """The yearly chart's description and text."""
    stats = Q.series_stats(series)
    text = T.alt_text(YEARLY_TITLE, "Yearly average sentiment: ", "MMM d, yyyy", "year", YEARLY_SHORT)
    return stats.select(text.alias("alt_text"), "points").crossJoin(Q.insight_text(series).select(T.truncate_lines(F.col("insights")).alias("text")))  # one row each
