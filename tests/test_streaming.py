"""Streams agree with batches."""

import time

from pyspark.sql import functions as F

from moodtide.streaming import history as H

SCHEMA = "seq long, uri string, likes long, reposts long, replies long, created_at timestamp"


def test_dedup_streams(spark, tmp_path):
    rows = [(1, "a", 1, 0, 0, "2024-01-01 00:00:00"), (2, "a", 5, 0, 0, "2024-01-01 00:01:00"), (3, "", 9, 0, 0, "2024-01-01 00:01:00"), (4, "b", 0, 0, 0, "2024-01-01 00:02:00"), (5, "z", 0, 0, 0, "2024-01-01 09:00:00")]
    df = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    H.append_once(H.first_of_uri(read()), str(tmp_path / "first"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r["uri"] for r in spark.read.parquet(str(tmp_path / "first")).collect()) == ["a", "b", "z"]
    H.append_once(H.best_of_uri(read()), str(tmp_path / "best"), str(tmp_path / "c2")).awaitTermination()
    assert {r["uri"]: r["seq"] for r in spark.read.parquet(str(tmp_path / "best")).collect()} == {"a": 2, "b": 4}


def test_daily_stream(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id"))).alias("ts"), (F.col("id") % 10).cast("double").alias("net"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, net double").parquet(str(tmp_path / "in"))
    H.append_once(H.daily_stream(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {str(r["date"]): r["total_runs"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and set(got.values()) == {24}


def test_hourly_trigger_runs_at_once(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    q = H.append_once(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), every="1 hour")
    try:
        for _ in range(100):
            if q.lastProgress is not None:
                break
            time.sleep(0.2)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 3 and q.isActive
    finally:
        q.stop()


def test_replayed_batch_is_stored_once(spark, tmp_path):
    """A batch whose commit is lost is written again under its own number."""
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: H.append_once(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    run()
    for f in (tmp_path / "c" / "commits").iterdir():
        f.unlink()
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3]


def test_alert_of_an_empty_first_page(spark, tmp_path):
    alerts = []
    listener = H.EmptyFirstPage(alerts.append)
    spark.streams.addListener(listener)
    try:
        for name, n in (("none", 0), ("some", 2)):
            spark.range(5).coalesce(1).write.parquet(str(tmp_path / name / "in"))
            rows = spark.readStream.schema("id long").parquet(str(tmp_path / name / "in")).where(F.col("id") < n)
            H.append_once(H.observed(rows), str(tmp_path / name / "out"), str(tmp_path / name / "c")).awaitTermination()
        for _ in range(50):
            if len(listener.seen) == 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert len(alerts) == 1


def test_state_within_a_time_to_live(spark, tmp_path):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:10:00"), ("a", 3, "2024-01-01 05:00:00"), ("b", 4, "2024-01-01 05:00:00"), ("z", 9, "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "run_id string, v int, at string").select("run_id", "v", F.col("at").cast("timestamp").alias("created_at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, v int, created_at timestamp").parquet(str(tmp_path / "in"))
    H.append_once(H.alive_stream(stream, 3600), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted((r["run_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 2), ("a", 3), ("b", 4)]
