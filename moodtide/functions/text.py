"""Text payloads: numbers, cuts, facets, keys, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodtide.schemas import GAP_MINUTES, NETWORK, POST_CHARS


def one_decimal(value: Column | str) -> Column:
    """Half-even on the binary value, as C prints it; Java's formatter rounds the decimal text instead."""

    def shown(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else f"{x:.1f}")

    return F.pandas_udf(shown, T.StringType())(value)


def percent_format(percent: Column) -> Column:
    return F.concat(F.when(percent > 0, F.lit("+")).otherwise(F.lit("")), one_decimal(percent), F.lit("%"))


def summary(mood: Column, percent: Column, lines: Column, network: str = NETWORK) -> Column:
    """Header, percent, and the numbered lines of the top posts (an ordered array of strings)."""
    return F.concat(F.lit(f"{network} is #"), mood, F.lit("\n"), percent_format(percent), F.lit(" sentiment\n\n"), F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))), ""))


def truncate_text(text: Column, limit: int = POST_CHARS) -> Column:
    """Cut by characters, so that none is split."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def truncate_lines(text: Column, limit: int = POST_CHARS, least: int = 150) -> Column:
    """Cut to the limit, at the last line break if that stands beyond ``least`` bytes."""
    cut = F.substring(text, 1, limit)
    head = F.regexp_replace(cut, r"\n[^\n]*\z", "")  # in Java $ stands before a last line break too
    return F.when(F.length(text) <= limit, text).when(F.contains(cut, F.lit("\n")) & (F.octet_length(head) > least), head).otherwise(cut)


def limit_status(text: Column, limit: int = POST_CHARS, in_bytes: bool = False) -> Column:
    left = limit - (F.octet_length(text) if in_bytes else F.length(text))
    return F.when(left < 0, "EXCEEDS_LIMIT").when(left < 50, "CLOSE_TO_LIMIT").otherwise("WITHIN_LIMIT")


def truncate_ellipsis(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def preview(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def _bytes_before(text: Column, at: Column) -> Column:
    return F.octet_length(F.left(text, at - 1))


def hashtag_facet(text: Column, network: str = NETWORK) -> Column:
    """Byte range of the header's hashtag, or null."""
    first = F.substring_index(text, "\n", 1)
    start = F.octet_length(F.lit(f"{network} is "))
    return F.when(text.startswith(f"{network} is #"), F.struct(start.cast("long").alias("start"), F.octet_length(first).cast("long").alias("end"), F.lit("tag").alias("kind"), F.regexp_replace(first, f"^{network} is #", "").alias("value")))


def handle_facets(text: Column, posts: Column) -> Column:
    """Byte ranges of @author for each post (struct of author, uri) that has a uri and stands in the text."""

    def facet(p: Column) -> Column:
        handle = F.concat(F.lit("@"), p["author"])
        at = F.position(handle, text)
        start = _bytes_before(text, at).cast("long")
        found = (p["uri"] != "") & (at > 0)
        return F.when(found, F.struct(start.alias("start"), (start + F.octet_length(handle)).cast("long").alias("end"), F.lit("link").alias("kind"), p["uri"].alias("value")))

    return F.filter(F.transform(posts, facet), lambda x: x.isNotNull())


def wiki_url(day: Column) -> Column:
    month, year, n = F.date_format(day, "MMMM"), F.year(day).cast("string"), F.dayofmonth(day).cast("string")
    return F.concat(F.lit("https://en.wikipedia.org/wiki/Portal:Current_events/"), month, F.lit("_"), year, F.lit("#"), year, F.lit("_"), month, F.lit("_"), n)


def event_facets(text: Column, today: Column, network: str = NETWORK) -> Column:
    """Byte range and page of each ``Sep 18 events``; the year is the title's first, else today's; no such date, no facet."""
    year = F.coalesce(F.regexp_extract(text, rf"{network} Sentiment (\d{{4}})-\d{{2}}-\d{{2}}", 1).try_cast("int"), F.year(today)).cast("string")
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]{2} \d{1,2} events)\b"), F.lit(1))

    def facet(x: Column, i: Column) -> Column:
        # the n-th equal phrase stands after n pieces of the text
        earlier = F.size(F.filter(F.slice(found, F.lit(1), i), lambda y: y == x))
        start = _nth(text, x, earlier)
        day = F.to_date(F.try_to_timestamp(F.concat(F.regexp_replace(x, " events$", ""), F.lit(" "), year), F.lit("MMM d yyyy")))
        return F.when(day.isNotNull(), F.struct(start.alias("start"), (start + F.octet_length(x)).cast("long").alias("end"), F.lit("link").alias("kind"), wiki_url(day).alias("value")))

    return F.filter(F.transform(found, facet), lambda x: x.isNotNull())


def _nth(text: Column, x: Column, earlier: Column) -> Column:
    pieces = F.split(text, F.concat(F.lit(r"\b\Q"), x, F.lit(r"\E\b")))
    head = F.slice(pieces, F.lit(1), earlier + 1)
    return (F.octet_length(F.array_join(head, "")) + earlier * F.octet_length(x)).cast("long")


def composite_key(key: Column) -> Column:
    """Struct of run_id and ts of ``run#ts``; null unless there are exactly two parts."""
    parts = F.split(key, "#")
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, F.lit(0)).alias("run_id"), F.get(parts, F.lit(1)).alias("ts")))


#: Status words and their signs.
STATUS_ICONS = {"completed": "✅", "success": "✅", "posted": "✅", "failed": "❌", "error": "❌", "in-progress": "🔄", "processing": "🔄", "fetching": "🔄"}
OTHER_ICON = "⏳"


def status_icon(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATUS_ICONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(status)), F.lit(OTHER_ICON))


def gap_severity(minutes: Column) -> Column:
    return F.when(minutes > 120, "CRITICAL").when(minutes > 60, "HIGH").when(minutes > 45, "MEDIUM").when(minutes > GAP_MINUTES, "LOW")


def format_bytes(n: Column) -> Column:
    """1024-based with one decimal, truncation-free arithmetic in the unit of the leading power."""
    value, unit = n.cast("double"), F.lit("B")
    for k, name in enumerate("KMGTPE", 1):
        value, unit = F.when(n >= 1024**k, n / float(1024**k)).otherwise(value), F.when(n >= 1024**k, f"{name}B").otherwise(unit)
    return F.concat(F.when(n >= 1024, one_decimal(value)).otherwise(n.cast("string")), F.lit(" "), unit)


def backup_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def parse_backup_stamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH-mm-ss'Z'"))


def image_kind(data: Column) -> Column:
    """By the first bytes of more than four; PNG is also the default."""
    jpeg = (F.octet_length(data) > 4) & (F.hex(F.substring(data, 1, 2)) == "FFD8")
    return F.when(jpeg, "image/jpeg").otherwise("image/png")


#: Trends of a description.
TRENDS = ("Trending positive", "Trending negative", "Stable sentiment")


def alt_text(title: str, stats: str, when: str, tail: str, short: str, least: int = 2) -> Column:
    """Sentences of a chart's description from a row of series_stats; the short one for fewer than least points."""

    def part(name: str, value: str, at: str) -> Column:
        return F.concat(F.lit(f"{name} sentiment: "), one_decimal(F.col(value)), F.lit("% ("), F.date_format(at, when), F.lit("). "))

    trend = F.when(F.col("trend") > 0, TRENDS[0]).when(F.col("trend") < 0, TRENDS[1]).otherwise(TRENDS[2])
    return F.when(F.col("points") < least, F.lit(short)).otherwise(F.concat(F.lit(title), part("Current", "current", "current_ts"), part("Highest", "highest", "highest_ts"), part("Lowest", "lowest", "lowest_ts"), F.lit(stats), one_decimal(F.col("average")), F.lit("%. "), trend, F.lit(f" over the {tail}.")))


# Messages for charts without enough points; %s is the sentence on what there is.
WEEKLY_MESSAGE = "📊 Building sentiment history...\n\n⏳ Sparkline charts will be available after collecting 7 days of data.\n📈 %s\n\n💡 In the meantime, check out the hourly sentiment summaries above!"
YEARLY_MESSAGE = "📊 Building yearly sentiment history...\n\n⏳ Yearly sentiment charts will be available after collecting 30+ days of daily data.\n📈 %s\n\n💡 In the meantime, check out the daily sentiment summaries and weekly sparklines!"


FIRST_WEEKLY, FIRST_YEARLY = "First chart expected in ~7 days.", "First yearly chart expected in ~30 days."
HAVE, NEED_WEEKLY, NEED_YEARLY = "Currently have ", " data points, need 2+ for charts.", " days, need 30+ for yearly charts."


def insufficient_text(points: Column, yearly: bool = False) -> Column:
    """The message for a chart that has too few points."""
    head, tail = (YEARLY_MESSAGE if yearly else WEEKLY_MESSAGE).split("%s")
    none, some = (FIRST_YEARLY, NEED_YEARLY) if yearly else (FIRST_WEEKLY, NEED_WEEKLY)
    return F.concat(F.lit(head), F.when(points == 0, F.lit(none)).otherwise(F.concat(F.lit(HAVE), points.cast("string"), F.lit(some))), F.lit(tail))
