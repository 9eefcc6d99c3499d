"""Operators on sentiment series (ts, net and counts): roll-ups, statistics, smoothing, trends.

Neighbours and row numbers come by prefix scans, never by a window without partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.functions.sentiment import score_category, series_color
from moodtide.operators.scan import scan
from moodtide.schemas import EXTREME_TOLERANCE, HISTORY_TTL_DAYS, INTERVAL_MINUTES, MIN_WEEKLY, MIN_YEARLY, WEEKLY_SIGMA, YEARLY_MARGIN

DAY = "INTERVAL 1 DAY"


def halfhour_history(rows: DataFrame, minutes: int = INTERVAL_MINUTES) -> DataFrame:
    """(ts, net) rows as one point for each run window: run_id, timestamp, net percent, category, posts."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / (60 * minutes)) * (60 * minutes))
    out = rows.groupBy(start.alias("timestamp")).agg(F.avg("net").alias("net_sentiment_percent"), F.count("*").alias("total_posts"))
    return out.select(
        F.concat(F.lit("run-"), F.unix_timestamp("timestamp").cast("string")).alias("run_id"), "timestamp", (F.col("net_sentiment_percent") / 100).alias("average_compound_score"), "net_sentiment_percent",
        score_category(F.col("net_sentiment_percent") / 100).alias("sentiment_category"), "total_posts", (F.unix_timestamp("timestamp") + HISTORY_TTL_DAYS * 86400).alias("ttl"),
    )


def daily_rollup(history: DataFrame, compat: bool = False) -> DataFrame:
    """Average, least, most, points and posts of each day; ``compat`` leaves out points at midnight exactly."""
    rows = history.where("timestamp <> date_trunc('DAY', timestamp)") if compat else history
    return rows.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.avg("net_sentiment_percent").alias("average_sentiment"), F.min("net_sentiment_percent").alias("min_sentiment"), F.max("net_sentiment_percent").alias("max_sentiment"), F.count("*").alias("total_runs"), F.sum("total_posts").alias("total_posts")
    )


def day_window(history: DataFrame, day: Column) -> DataFrame:
    """Points of one day, open at both ends."""
    start = F.date_trunc("DAY", day)
    return history.where((F.col("timestamp") > start) & (F.col("timestamp") < start + F.expr(DAY)))


def daily_between(daily: DataFrame, days: int, today: Column) -> DataFrame:
    return daily.where(F.col("date").between(F.date_sub(today, days), today))


def daily_point_get(daily: DataFrame, day: Column) -> DataFrame:
    """The row of one day; an error where there is none."""
    found = daily.where(F.col("date") == day)
    lacks = found.agg(F.count("*").alias("n")).select(F.assert_true(F.col("n") > 0, F.concat(F.lit("no daily row for "), day.cast("string"))).alias("ok"))
    return found.crossJoin(F.broadcast(lacks)).where("ok IS NULL").drop("ok")  # one row


def days_after(day: Column, days: int = 0, months: int = 0) -> Column:
    """A day some days and months later."""
    return F.add_months(F.date_add(day, days), months) if months else F.date_add(day, days)


def new_days(daily: DataFrame, existing: DataFrame) -> DataFrame:
    """Days that are not stored yet."""
    return daily.join(existing.select("date"), "date", "left_anti")


def yearly_series(daily: DataFrame, today: Column, days: int = 365) -> DataFrame:
    return daily_between(daily, days, today).where("date IS NOT NULL").select("date", "average_sentiment", "min_sentiment", "max_sentiment", F.col("date").cast("timestamp").alias("timestamp"), F.col("average_sentiment").alias("net_sentiment_percent")).orderBy("date")


def series_stats(series: DataFrame, ts: str = "timestamp", v: str = "net_sentiment_percent") -> DataFrame:
    """Current, highest and lowest value with their times (the first of equals), average, and last minus first."""
    high, low = F.min(F.struct((-F.col(v)).alias("k"), F.col(ts).alias("t"))), F.min(F.struct(F.col(v).alias("k"), F.col(ts).alias("t")))
    first, last = F.min(F.struct(F.col(ts).alias("t"), F.col(v).alias("k"))), F.max(F.struct(F.col(ts).alias("t"), F.col(v).alias("k")))
    out = series.agg(high.alias("h"), low.alias("l"), first.alias("f"), last.alias("z"), F.avg(v).alias("average"), F.count("*").alias("points"))
    return out.select(F.col("z.k").alias("current"), F.col("z.t").alias("current_ts"), (-F.col("h.k")).alias("highest"), F.col("h.t").alias("highest_ts"), F.col("l.k").alias("lowest"), F.col("l.t").alias("lowest_ts"), "average", (F.col("z.k") - F.col("f.k")).alias("trend"), "points")


def y_range(series: DataFrame, v: str = "net_sentiment_percent") -> DataFrame:
    """Axis: least and most with a tenth of the range, 5 at least, around; centre; scale. An empty series: -100 to 100."""
    one = series.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    pad = F.greatest((F.col("hi") - F.col("lo")) * 0.1, F.lit(5.0))
    out = one.select(F.coalesce(F.col("lo") - pad, F.lit(-100.0)).alias("y_min"), F.coalesce(F.col("hi") + pad, F.lit(100.0)).alias("y_max"))
    return out.select("y_min", "y_max", ((F.col("y_min") + F.col("y_max")) / 2).alias("center"), (200.0 / (F.col("y_max") - F.col("y_min"))).alias("scale"))


def extremes_rows(series: DataFrame, ts: str = "timestamp", v: str = "net_sentiment_percent") -> DataFrame:
    s = series_stats(series, ts, v)
    return s.select(F.lit("lowest").alias("kind"), F.col("lowest_ts").alias("ts"), F.col("lowest").alias("value")).union(s.select(F.lit("highest"), "highest_ts", "highest"))


def gaussian_smooth(series: DataFrame, sigma: float = WEEKLY_SIGMA, ts: str = "timestamp", v: str = "net_sentiment_percent") -> DataFrame:
    """Normalised Gaussian weights over row distance, of all rows: beyond 39 sigma a weight is 0 as a double, so those rows add nothing.

    Each point meets those within reach by an equi-join on blocks of row numbers, never by a cross join; row numbers come by a prefix scan.
    """
    reach = int(39 * sigma) + 1
    numbered = scan(series.select(F.col(ts).alias("ts"), F.col(v).alias("value")), ["ts"], row="i").withColumn("i", F.col("i") - 1)
    block = max(reach, 1)
    left = numbered.select("i", "ts", "value", F.explode(F.array(*(F.floor(F.col("i") / block) + k for k in (-1, 0, 1)))).alias("b"))
    right = numbered.select(F.col("i").alias("j"), F.col("value").alias("other"), F.floor(F.col("i") / block).alias("b"))
    near = left.join(right, "b").where(F.abs(F.col("i") - F.col("j")) <= reach)
    d = (F.col("i") - F.col("j")).cast("double")
    w = F.exp(-(d * d) / (2 * sigma * sigma))
    return near.groupBy("i", "ts", "value").agg((F.sum(w * F.col("other")) / F.sum(w)).alias("smoothed")).drop("i")


def with_position(series: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Place of each instant between the first and the last, from 0 to 1; null for a single instant."""
    t = F.unix_micros(ts)
    ends = series.agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    return series.crossJoin(F.broadcast(ends)).withColumn("position", F.try_divide((t - F.col("t0")).cast("double"), (F.col("t1") - F.col("t0")).cast("double"))).drop("t0", "t1")  # one row


def average(series: DataFrame, v: str = "net_sentiment_percent") -> DataFrame:
    return series.agg(F.avg(v).alias("average"))


def segments(series: DataFrame, ts: str = "timestamp", v: str = "net_sentiment_percent") -> DataFrame:
    """Pairs of neighbours with the colour of the left one, by a prefix scan."""
    rows = scan(series.select(F.col(ts).alias("to_ts"), F.col(v).alias("to_value")), ["to_ts"], prevs=["to_ts", "to_value"])
    out = rows.select(F.col("prev_to_ts").alias("from_ts"), F.col("prev_to_value").alias("from_value"), "to_ts", "to_value")
    return out.where("from_ts IS NOT NULL").withColumn("color", series_color(F.col("from_value")))


def first_last(series: DataFrame, ts: str = "timestamp", v: str = "net_sentiment_percent") -> DataFrame:
    return series.agg(F.min(ts).alias("first_ts"), F.min_by(v, ts).alias("first_value"), F.max(ts).alias("last_ts"), F.max_by(v, ts).alias("last_value"))


def latest_is_extreme(series: DataFrame, tolerance: float = EXTREME_TOLERANCE) -> DataFrame:
    s = series_stats(series)
    kind = F.when(F.col("points") < MIN_WEEKLY, "").when(F.col("current") <= F.col("lowest") + tolerance, "Lowest").when(F.col("current") >= F.col("highest") - tolerance, "Highest").otherwise("")
    return s.select("current", "lowest", "highest", kind.alias("extreme"))


def extreme_note(extreme: Column) -> Column:
    return F.when(extreme != "", F.concat(F.lit("* "), extreme, F.lit(" sentiment for the charted period"))).otherwise("")


def latest_vs_average(series: DataFrame, margin: float = YEARLY_MARGIN, least: int = MIN_YEARLY) -> DataFrame:
    s = series_stats(series)
    kind = F.when(F.col("points") < least, "").when(F.col("current") > F.col("average") + margin, "above").when(F.col("current") < F.col("average") - margin, "below").otherwise("")
    return s.select("points", "current", "average", kind.alias("position"))


def insight_text(series: DataFrame) -> DataFrame:
    """The yearly lines: above or below average, lowest and highest with their dates."""
    from moodtide.functions.text import one_decimal

    s = series_stats(series).join(latest_vs_average(series).select("position"))  # one row each
    line = F.when(F.col("position") != "", F.concat(F.lit("Currently "), F.col("position"), F.lit(" yearly average")))

    def extreme(name: str, v: str, t: str) -> Column:
        return F.concat(F.lit(f"{name}: "), one_decimal(F.col(v)), F.lit("% "), F.date_format(t, "MMM d"), F.lit(" events"))

    lines = F.array(line, extreme("Lowest", "lowest", "lowest_ts"), extreme("Highest", "highest", "highest_ts"))
    return s.select(F.when(F.col("points") >= MIN_YEARLY, F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")).otherwise("").alias("insights"))


def since(history: DataFrame, after: Column) -> DataFrame:
    return history.where(F.col("timestamp") >= after).orderBy("timestamp", "run_id")
