"""The driver's tables as posts, history and runs, in Spark and (for the oracle) in SQL. Both say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.operators import series as Q

CUTOFF, NOW = "2024-01-01 06:00:00", "2024-01-02 18:00:00"
END = "2024-01-31 00:00:00"


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, dealt to all of them; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post for each document: uri by text, so that copies collide; the time of the event of its number."""
    d, e = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"))
    toxic = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("t"))
    out = d.join(e, d.doc_id == e.event_id).join(toxic, "doc_id", "left")
    return out.select(
        F.md5("text").alias("uri"), F.concat(F.lit("cid-"), F.col("doc_id").cast("string")).alias("cid"), "text", F.col("source").alias("author"), (F.col("doc_id") % 97).alias("likes"), (F.col("n_chars") % 31).alias("reposts"), (F.col("doc_id") % 13).alias("replies"),
        "created_at", F.col("doc_id").alias("seq"), "lang", F.coalesce("t", F.lit(0)).alias("toxic"),
    )


POSTS = """posts AS (SELECT md5(d.text) AS uri, 'cid-' || d.doc_id AS cid, d.text, d.source AS author, d.doc_id % 97 AS likes, d.n_chars % 31 AS reposts, d.doc_id % 13 AS replies,
  e.ts AS created_at, d.doc_id AS seq, d.lang, coalesce(l.toxic, 0) AS toxic FROM documents d JOIN events e ON d.doc_id = e.event_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def score() -> Column:
    """A deterministic compound in [-1, 1] that stands in for the scorer where an oracle has to follow."""
    return ((F.col("likes") * 7 + F.col("reposts") * 3) % 201 - 100) / 100.0


SCORE = "((likes * 7 + reposts * 3) % 201 - 100) / 100.0"


def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("value") - 50)).alias("net"), "user_id", "event_id")


RAW = "raw AS (SELECT ts, greatest(-100.0, least(100.0, value - 50)) AS net, user_id, event_id FROM events)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.halfhour_history(raw_history(spark, sf_dir))


HISTORY = (
    RAW
    + """, h0 AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS "timestamp", avg(net) AS net_sentiment_percent, count(*) AS total_posts FROM raw GROUP BY 1),
history AS (SELECT 'run-' || epoch("timestamp")::BIGINT AS run_id, "timestamp", net_sentiment_percent / 100 AS average_compound_score, net_sentiment_percent,
  CASE WHEN net_sentiment_percent / 100 >= 0.3 THEN 'positive' WHEN net_sentiment_percent / 100 <= -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_category, total_posts, epoch("timestamp")::BIGINT + 14 * 86400 AS ttl FROM h0)"""
)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.daily_rollup(history(spark, sf_dir))


DAILY = (
    HISTORY
    + """, daily AS (SELECT "timestamp"::DATE AS date, avg(net_sentiment_percent) AS average_sentiment, min(net_sentiment_percent) AS min_sentiment, max(net_sentiment_percent) AS max_sentiment,
  count(*) AS total_runs, sum(total_posts)::BIGINT AS total_posts FROM history GROUP BY 1)"""
)


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.yearly_series(daily(spark, sf_dir), F.lit("2024-01-31").cast("date"))


SERIES = DAILY + """, series AS (SELECT date, average_sentiment, min_sentiment, max_sentiment, date::TIMESTAMP AS "timestamp", average_sentiment AS net_sentiment_percent FROM daily WHERE date BETWEEN DATE '2024-01-31' - 365 AND DATE '2024-01-31')"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run states: a run for each half hour, with a failure in every seventh."""
    h, n = history(spark, sf_dir), F.unix_timestamp("timestamp") / 1800
    failed = F.col("k") % 7 == 0
    out = h.withColumn("k", n.cast("long"))
    return out.select(
        "run_id", F.lit("orchestrator").alias("step"), F.when(failed, "failed").otherwise("completed").alias("status"), F.col("timestamp").alias("created_at"), (F.col("timestamp") + F.expr("INTERVAL 12 MINUTES")).alias("updated_at"), (F.col("timestamp") - F.expr("INTERVAL 30 MINUTES")).alias("cutoff_time"),
        (F.col("total_posts") + F.col("k") % 3).alias("total_posts_retrieved"), F.when(failed, F.concat(F.lit("error "), F.col("k").cast("string"))).otherwise("").alias("error_message"), F.when(failed & (F.col("k") % 2 == 0), F.col("timestamp") + F.expr("INTERVAL 5 MINUTES")).alias("last_error_time"),
    )


RUNS = (
    HISTORY
    + """, r0 AS (SELECT *, epoch("timestamp")::BIGINT // 1800 AS k FROM history),
runs AS (SELECT run_id, 'orchestrator' AS step, CASE WHEN k % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, "timestamp" AS created_at, "timestamp" + INTERVAL 12 MINUTES AS updated_at, "timestamp" - INTERVAL 30 MINUTES AS cutoff_time,
  total_posts + k % 3 AS total_posts_retrieved, CASE WHEN k % 7 = 0 THEN 'error ' || k ELSE '' END AS error_message, CASE WHEN k % 14 = 0 THEN "timestamp" + INTERVAL 5 MINUTES END AS last_error_time FROM r0)"""
)


def run_post_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of runs: an event is a post of its half hour."""
    r = raw_history(spark, sf_dir)
    start = F.floor(F.unix_timestamp("ts") / 1800) * 1800
    return r.select(F.concat(F.lit("run-"), start.cast("string")).alias("run_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("likes"))


RUN_POSTS = "run_posts AS (SELECT 'run-' || epoch(time_bucket(INTERVAL 30 MINUTES, ts))::BIGINT AS run_id, event_id AS seq, user_id % 50 AS likes FROM raw)"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the steps of each run: all have an orchestrator and an aggregator, some a fetcher and an analyzer."""
    h = history(spark, sf_dir).withColumn("k", (F.unix_timestamp("timestamp") / 1800).cast("long"))

    def step(name: str, status: str, minutes: int, overall=None, net=None) -> DataFrame:
        rows = h.select("run_id", "k", F.lit(name).alias("step"), F.lit(status).alias("status"), (overall if overall is not None else F.lit("")).alias("overall_sentiment"), (net if net is not None else F.lit(0.0)).alias("net_sentiment_percentage"), F.col("timestamp").alias("created_at"), (F.col("timestamp") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("updated_at"))
        return rows.where({"fetcher": "k % 2 = 0", "analyzer": "k % 3 <> 0"}.get(name, "true")).drop("k")

    out = step("orchestrator", "started", 0).union(step("fetcher", "fetching", 1))
    return out.union(step("analyzer", "done", 2, F.col("sentiment_category"), F.col("net_sentiment_percent"))).union(step("aggregator", "done", 3))


def _step_sql(name: str, status: str, minutes: int, overall: str = "''", net: str = "0.0") -> str:
    some = {"fetcher": "WHERE k % 2 = 0", "analyzer": "WHERE k % 3 <> 0"}.get(name, "")
    return f"""SELECT run_id, '{name}' AS step, '{status}' AS status, {overall} AS overall_sentiment, {net}::DOUBLE AS net_sentiment_percentage, "timestamp" AS created_at, "timestamp" + INTERVAL {minutes} MINUTES AS updated_at FROM s0 {some}"""


STATES = (
    HISTORY
    + ', s0 AS (SELECT *, epoch("timestamp")::BIGINT // 1800 AS k FROM history), states AS ('
    + " UNION ALL ".join([_step_sql("orchestrator", "started", 0), _step_sql("fetcher", "fetching", 1), _step_sql("analyzer", "done", 2, "sentiment_category", "net_sentiment_percent"), _step_sql("aggregator", "done", 3)])
    + ")"
)
