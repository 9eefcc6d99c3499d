"""Operators on posts: clean-up, dedup, scoring, ranking, window and page statistics. DataFrame in, DataFrame out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodtide.functions import posts as P
from moodtide.functions import sentiment as S
from moodtide.schemas import PAGE_SIZE, TOP_N

PAGES_PER_BLOCK = 4096


def from_raw(raw: DataFrame, prefix_missing: bool = False) -> DataFrame:
    """API rows as posts: flat columns, absent counters as 0, full uris. ``prefix_missing``: a text in place of none."""
    text = F.col("record.text")
    fallback = F.concat(F.lit("Post by @"), F.coalesce("author.handle", F.lit(""))) if prefix_missing else F.lit("")
    return raw.select(
        P.uri_normalise(F.coalesce("uri", F.lit("")), F.col("author.did")).alias("uri"), F.coalesce("cid", F.lit("")).alias("cid"), F.coalesce(text, fallback).alias("text"), F.coalesce("author.handle", F.lit("")).alias("author"),
        *(F.coalesce(f"{k}_count", F.lit(0)).alias(f"{k}s" if k != "reply" else "replies") for k in ("like", "repost", "reply")), F.col("indexed_at").alias("created_at"), "labels",
    )


def since(posts: DataFrame, cutoff: Column | dt.datetime | str, column: str = "created_at") -> DataFrame:
    """Rows not before the cutoff; rows without an instant go."""
    return posts.where(F.col(column) >= cutoff)


def without_adult(posts: DataFrame) -> DataFrame:
    return posts.where(~P.is_adult(F.col("labels")))


def invalidated(posts: DataFrame) -> DataFrame:
    return posts.withColumn("uri", P.uri_invalidate(F.col("uri")))


def dedup_by_uri(posts: DataFrame) -> DataFrame:
    """The most engaged row of each uri, the first arrived (``seq``, unique) of equals; empty uris go. Null counters are 0, a null seq comes last.

    Engagement and seq make one number, whose maximum by uri is a hash aggregate; texts take no part in it, and only then are
    rows picked by (uri, seq).
    """
    unit = F.lit("1" + 19 * "0").cast("decimal(20,0)")
    engaged = sum((F.coalesce(c, F.lit(0)) for c in ("replies", "likes", "reposts")), F.lit(0))
    rows = posts.where("uri <> ''").withColumn("_seq", F.coalesce(F.col("seq").cast("long"), F.lit(1 << 62)))
    best = rows.groupBy("uri").agg(F.max(engaged.cast("decimal(18,0)") * unit - F.col("_seq")).alias("best"))
    first = best.select("uri", F.pmod(-F.col("best"), unit).cast("long").alias("_seq"))
    return rows.join(first, ["uri", "_seq"], "left_semi").drop("_seq")


def scored(posts: DataFrame, score: Column | None = None) -> DataFrame:
    """Posts with sentiment_score, sentiment, topics and engagement_score."""
    value = F.lit(0.0) if score is None else score
    out = posts.withColumn("sentiment_score", value)
    return out.withColumns({"sentiment": S.combined_category(F.col("sentiment_score"), F.col("text")), "topics": S.topics(F.col("text")), "engagement_score": P.engagement()})


def top_posts(posts: DataFrame, n: int = TOP_N) -> DataFrame:
    """The n most engaged posts with their rank; ties by uri."""
    top = posts.withColumn("engagement_score", P.engagement()).orderBy(F.desc("engagement_score"), "uri").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("engagement_score"), "uri")))  # n rows


def overall_sentiment(scored_posts: DataFrame, clamp: bool = True) -> DataFrame:
    """One row: mean compound, its category and percent; no rows give neutral and 0."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sentiment_score"))) if clamp else F.col("sentiment_score")
    one = scored_posts.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("average_compound"), F.count("*").alias("total_posts"))
    return one.select("total_posts", "average_compound", S.score_category(F.col("average_compound")).alias("overall_sentiment"), (F.col("average_compound") * 100).alias("net_percent"))


def sentiment_counts(scored_posts: DataFrame) -> DataFrame:
    own = S.score_category(F.col("sentiment_score"))
    return scored_posts.agg(*(F.count_if(own == k).alias(k) for k in ("positive", "neutral", "negative")))


def time_histogram(posts: DataFrame, cutoff: Column, now: Column, buckets: int = 6, samples: int = 3, column: str = "created_at") -> DataFrame:
    """Counts and first uris of equal half-open parts of [cutoff, now); empty parts stay."""
    width = (F.unix_micros(now) - F.unix_micros(cutoff)) / buckets
    at = F.floor((F.unix_micros(F.col(column)) - F.unix_micros(cutoff)) / width).cast("int")
    inside = posts.where((F.col(column) >= cutoff) & (F.col(column) < now)).withColumn("bucket", at)
    firsts = first_rows(inside, "bucket", samples).withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("seq")))
    lists = firsts.groupBy("bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "uri"))), lambda x: x["uri"]), ",").alias("samples"))
    counted = inside.groupBy("bucket").agg(F.count("*").alias("n"))
    spine = posts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(counted, "bucket", "left").join(lists, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("samples", F.lit("")).alias("samples"))


def first_rows(rows: DataFrame, key: str, k: int, order: str = "seq") -> DataFrame:
    """The first k rows of each key, in order; a limit before the shuffle keeps a hot key out of one task."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= k).drop("_r")


def coverage_span(posts: DataFrame, column: str = "created_at") -> DataFrame:
    first, last = F.min(column), F.max(column)
    return posts.agg(first.alias("first_ts"), last.alias("last_ts"), ((F.unix_micros(last) - F.unix_micros(first)) / 6e7).alias("span_minutes"))


def window_validation(posts: DataFrame, cutoff: Column, now: Column, slack_seconds: int = 0, column: str = "created_at") -> DataFrame:
    """Rows inside, before and after a closed window."""
    t, slack = F.unix_micros(F.col(column)), slack_seconds * 1_000_000
    before, after = t < F.unix_micros(cutoff) - slack, t > F.unix_micros(now) + slack
    return posts.agg(F.count_if(~before & ~after).alias("inside"), F.count_if(before).alias("before"), F.count_if(after).alias("after"))


def funnel_counts(posts: DataFrame, cutoff: Column, column: str = "created_at") -> DataFrame:
    """From the source, after the time filter, and distinct uris of those, in one pass."""
    ok = F.col(column) >= cutoff
    out = posts.agg(F.count("*").alias("from_api"), F.count_if(ok).alias("after_time"), F.count_distinct(F.when(ok & (F.col("uri") != ""), F.col("uri"))).alias("after_dedup"))
    return out.withColumn("filtered_percent", F.coalesce(F.try_divide((F.col("from_api") - F.col("after_time")) * 100.0, F.col("from_api")), F.lit(0.0)))


def with_page(posts: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return posts.withColumn("page", F.floor(F.col("seq") / size).cast("int"))


def page_distinct_counts(posts: DataFrame) -> DataFrame:
    """Per page: rows, uris not seen on any page before, and the running number of distinct uris."""
    firsts = posts.groupBy("uri").agg(F.min(F.struct("page", "seq")).alias("f")).groupBy(F.col("f.page").alias("page")).agg(F.count("*").alias("fresh"))
    pages = posts.groupBy("page").agg(F.count("*").alias("rows")).join(firsts, "page", "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    # running sums in blocks of pages; sums of whole blocks, a 4096th as many, are summed in one window
    block = F.floor(F.col("page") / PAGES_PER_BLOCK).alias("block")
    blocks = pages.groupBy(block).agg(F.sum("fresh").alias("s"))
    before = blocks.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"))
    running = F.sum("fresh").over(Window.partitionBy("block").orderBy("page"))
    out = pages.select("page", "rows", "fresh", block).select("*", running.alias("running")).join(before, "block")
    return out.select("page", "rows", (F.col("rows") - F.col("fresh")).alias("duplicates"), (F.col("running") + F.col("before")).alias("distinct_so_far"))


def page_top(posts: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("uri", "seq"), F.struct(P.engagement().alias("e"), (-F.col("seq")).alias("s")))
    return posts.groupBy("page").agg(best.alias("b"), F.max(P.engagement()).alias("engagement")).select("page", "b.uri", "b.seq", "engagement")


def topic_counts(posts: DataFrame) -> DataFrame:
    return posts.select(F.explode(S.topics(F.col("text"))).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def embed_candidate(top: DataFrame) -> DataFrame:
    """The best ranked post that can be embedded."""
    return top.where("uri <> '' AND cid <> '' AND NOT startswith(uri, 'at://post-')").orderBy("rank").limit(1)


def should_publish(total: Column, top_size: Column, overall: Column) -> Column:
    return (F.coalesce(total, F.lit(0)) > 0) & (F.coalesce(top_size, F.lit(0)) > 0) & (F.coalesce(overall, F.lit("")) != "")


def distinct_uris(posts: DataFrame) -> DataFrame:
    """First arrived row of each uri."""
    return posts.groupBy("uri").agg(F.min("seq").alias("seq"))
