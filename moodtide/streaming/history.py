"""Structured Streaming forms of the runs: windowed history, dedup, daily roll-up, idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from moodtide.functions import posts as P
from moodtide.schemas import INTERVAL_MINUTES


def history_stream(rows: DataFrame, minutes: int = INTERVAL_MINUTES, late: str = "30 minutes") -> DataFrame:
    """(ts, net) rows as one point a window; rows later than the watermark are dropped."""
    w = F.window("ts", f"{minutes} minutes")
    out = rows.withWatermark("ts", late).groupBy(w).agg(F.avg("net").alias("net_sentiment_percent"), F.count("*").alias("total_posts"))
    return out.select(F.col("window.start").alias("timestamp"), "net_sentiment_percent", "total_posts")


def daily_stream(rows: DataFrame, late: str = "1 day") -> DataFrame:
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.avg("net").alias("average_sentiment"), F.min("net").alias("min_sentiment"), F.max("net").alias("max_sentiment"), F.count("*").alias("total_runs"))
    return out.select(F.to_date("window.start").alias("date"), "average_sentiment", "min_sentiment", "max_sentiment", "total_runs")


def first_of_uri(posts: DataFrame, ts: str = "created_at", late: str = "30 minutes") -> DataFrame:
    """The first arrived row of each uri within the watermark."""
    return posts.where("uri <> ''").withWatermark(ts, late).dropDuplicatesWithinWatermark(["uri"])


def best_of_uri(posts: DataFrame, minutes: int = INTERVAL_MINUTES, ts: str = "created_at", late: str = "30 minutes") -> DataFrame:
    """The most engaged row of each uri and window."""
    best = F.max_by(F.struct(*posts.columns), F.struct(P.engagement().alias("e"), (-F.col("seq")).alias("s")))
    out = posts.where("uri <> ''").withWatermark(ts, late).groupBy(F.window(ts, f"{minutes} minutes"), F.col("uri").alias("_u")).agg(best.alias("_b"))
    return out.select("_b.*")


def observed(rows: DataFrame, name: str = "pages") -> DataFrame:
    """rows, counted in each batch's progress under a name."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


class EmptyFirstPage(StreamingQueryListener):
    """Alerts once for each query whose first batch has no rows."""

    def __init__(self, alert, name: str = "pages"):
        self.alert, self.name, self.seen = alert, name, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.id) in self.seen or self.name not in p.observedMetrics:
            return
        self.seen.add(str(p.id))
        if p.observedMetrics[self.name]["rows"] == 0:
            self.alert(str(p.id))

    def onQueryTerminated(self, event) -> None:
        pass


def alive_stream(rows: DataFrame, seconds: int, ts: str = "created_at") -> DataFrame:
    """The latest row of each run_id within a time to live: state older than the watermark is evicted."""
    best = F.max_by(F.struct(*rows.columns), F.col(ts))
    out = rows.withWatermark(ts, f"{seconds} seconds").groupBy(F.session_window(ts, f"{seconds} seconds"), F.col("run_id").alias("_r")).agg(best.alias("_b"))
    return out.select("_b.*")


def append_once(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends each micro-batch under its own batch_id partition, which a retried batch replaces: exactly once.

    All that there is, then an end; with ``every`` ("1 hour") at once and then again each so often.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
