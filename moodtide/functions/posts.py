"""Clean-up expressions of posts and uris."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodtide.schemas import ADULT_LABELS, POST_COLLECTION, WEB_PROFILE


def engagement() -> Column:
    return (F.col("replies") + F.col("likes") + F.col("reposts")).cast("double")


def parsed_time(created_at: Column) -> Column:
    """The instant of an RFC 3339 string; null where it can't be parsed."""
    return F.try_to_timestamp(created_at)


def is_adult(labels: Column) -> Column:
    return F.coalesce(F.exists(labels, lambda x: x["val"].isin(*ADULT_LABELS)), F.lit(False))


def uri_normalise(uri: Column, did: Column) -> Column:
    own = F.coalesce(did, F.lit("")) != ""
    return F.when(~uri.startswith("at://") & own, F.concat(F.lit("at://"), did, F.lit(f"/{POST_COLLECTION}/"), F.regexp_replace(uri, "^post-", ""))).otherwise(uri)


def uri_invalidate(uri: Column) -> Column:
    return F.when(uri.startswith("at://post-"), F.lit("")).otherwise(uri)


def at_uri_to_web(uri: Column) -> Column:
    """The web address of a post; another at:// uri only loses its scheme, all else stays."""
    rest = F.regexp_replace(uri, "^at://", "")
    parts = F.split(rest, "/")
    post = (F.size(parts) >= 3) & (F.get(parts, F.lit(1)) == POST_COLLECTION)
    return F.when(~uri.startswith("at://"), uri).when(post, F.concat(F.lit(WEB_PROFILE), parts[0], F.lit("/post/"), F.get(parts, F.lit(2)))).otherwise(rest)


def cursor_add(cursor: Column, n: int | Column) -> Column:
    return (F.coalesce(cursor.try_cast("bigint"), F.lit(0)) + n).cast("string")
