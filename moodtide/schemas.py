"""Explicit schemas of every table, and the constants that are part of the semantics."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _d, _t = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


POST_RAW = _struct(
    uri=_s, cid=_s, indexed_at=_s, author=_struct(did=_s, handle=_s), record=_struct(text=_s), labels=T.ArrayType(_struct(val=_s)),
    like_count=_l, repost_count=_l, reply_count=_l,
)
POST = _struct(uri=_s, cid=_s, text=_s, author=_s, likes=_l, reposts=_l, replies=_l, created_at=_s, seq=_l)
SCORED_POST = T.StructType([*POST.fields, *_struct(sentiment=_s, sentiment_score=_d, topics=T.ArrayType(_s), engagement_score=_d).fields])
POST_BATCH = _struct(run_id=_s, post_id=_s, posts=T.ArrayType(POST), ttl=_l)
POST_ITEM = _struct(run_id=_s, post_id=_s, post=POST, ttl=_l)
RUN = _struct(
    run_id=_s, post_id=_s, step=_s, status=_s, analysis_interval_minutes=_l, cutoff_time=_t, current_cursor=_s, total_posts_retrieved=_l,
    has_more_posts=T.BooleanType(), overall_sentiment=_s, net_sentiment_percentage=_d, top_posts=T.ArrayType(POST), top_post_uri=_s, top_post_cid=_s,
    created_at=_t, updated_at=_t, ttl=_l, error_message=_s, retry_count=_l, last_error_time=_t, last_error_step=_s, processing_time_ms=_l, posts_per_second=_d, memory_usage_mb=_l,
)
HISTORY = _struct(run_id=_s, timestamp=_t, average_compound_score=_d, net_sentiment_percent=_d, sentiment_category=_s, total_posts=_l, created_at=_t, ttl=_l)
DAILY = _struct(date=T.DateType(), run_id=_s, average_sentiment=_d, min_sentiment=_d, max_sentiment=_d, total_runs=_l, total_posts=_l, created_at=_t, ttl=_l)
YEARLY = _struct(date=T.DateType(), average_sentiment=_d, min_sentiment=_d, max_sentiment=_d, timestamp=_t, net_sentiment_percent=_d)
MANIFEST = _struct(
    backup_timestamp=_s, backup_version=_s, checksum=_s, total_items=_l,
    tables=T.ArrayType(_struct(table_name=_s, item_count=_l, file_size=_l, file_name=_s, checksum=_s, backup_duration=_s)),
)

# Fixed values.
ADULT_LABELS = ("porn", "sexual", "nudity", "graphic-media")
STEPS = ("orchestrator", "fetcher", "analyzer", "aggregator", "poster")
POST_COLLECTION = "app.bsky.feed.post"
WEB_PROFILE = "https://bsky.app/profile/"
NETWORK = "Bluesky"
TOP_N, PAGE_SIZE, MAX_PAGES, POSTS_PER_BATCH, POST_CHARS = 5, 100, 100, 100, 300
SCORE_THRESHOLD, COLOR_THRESHOLD = 0.3, 10.0
EXTREME_TOLERANCE, YEARLY_MARGIN, MIN_WEEKLY, MIN_YEARLY = 0.01, 5.0, 2, 30
GAP_MINUTES, RUNS_PER_DAY, INTERVAL_MINUTES = 35, 48, 30
RUN_TTL_DAYS, HISTORY_TTL_DAYS, DAILY_TTL_DAYS = 2, 14, 3 * 365
WEEKLY_SIGMA, YEARLY_SIGMA = 4.0, 2.0
