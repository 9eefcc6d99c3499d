"""State with a time to live."""

from pyspark.sql import functions as F

from moodtide.streaming import history as H
from moodtide.streaming import ttl


def test_runs_are_evicted_and_come_again(spark, tmp_path):
    ttl.with_store(spark)
    steps = [
        [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 06:00:00"), ("b", "2024-01-01 01:00:00")],
        [("b", "2024-01-02 20:00:00"), ("c", "2024-01-02 21:00:00")],
        [("d", "2024-01-04 03:00:00")],  # the watermark passes the end of a (2024-01-03 06:00), not that of b (2024-01-04 20:00)
        [("a", "2024-01-04 04:00:00"), ("z", "2024-01-20 00:00:00")],
    ]
    seen = []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, "run_id string, at string").select("run_id", F.col("at").cast("timestamp").alias("created_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("run_id string, created_at timestamp").parquet(str(tmp_path / "in"))
        H.append_once(ttl.lives(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        all_rows = sorted((r["run_id"], r["kind"], r["rows"], str(r["until"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        new = list(all_rows)
        for x in seen:
            new.remove(x)
        seen = all_rows
        if i == 0:
            assert new == [("a", "alive", 2, "2024-01-03 06:00:00"), ("b", "alive", 1, "2024-01-03 01:00:00")]
        if i == 1:
            assert new == [("b", "alive", 2, "2024-01-04 20:00:00"), ("c", "alive", 1, "2024-01-04 21:00:00")]
        if i == 2:
            assert new == [("a", "evicted", 2, "2024-01-03 06:00:00"), ("d", "alive", 1, "2024-01-06 03:00:00")]
    assert ("a", "alive", 1, "2024-01-06 04:00:00") in seen and ("b", "evicted", 2, "2024-01-04 20:00:00") in seen and ("z", "alive", 1, "2024-01-22 00:00:00") in seen
    assert sum(k == "evicted" for _, k, _, _ in seen) == 5
