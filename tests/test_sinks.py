"""Sinks: delivery in batches, snapshots with conflicts."""

import pytest
from pyspark.sql import functions as F

from moodtide.sources import outbox
from moodtide.sources.snapshots import Conflict, Snapshots, append_posts


class Moody(outbox.Outbox):
    """Refuses a part of each batch at first, and fails on the row that ``poison`` names while its file is missing."""

    @classmethod
    def name(cls):
        return "moody"

    def receiver(self, folder, task):
        inner, options = outbox.FolderReceiver(folder, task), dict(self.options)

        class Receiver:
            names, seen = inner.names, set()

            def send(self, items):
                if "poison" in options and any(str(x["id"]) == options["poison"] for x in items):
                    raise RuntimeError("the receiver is gone")
                late = [x for x in items if x["id"] % 3 == 0 and x["id"] not in self.seen]
                self.seen |= {x["id"] for x in late}
                inner.send([x for x in items if x not in late])
                return late

            finish = staticmethod(inner.finish)

        return Receiver()


def test_batches_of_all_partitions_and_refusals(spark, tmp_path):
    outbox.deliver(spark.range(0, 230, numPartitions=4), str(tmp_path), key="id", source=Moody, pause=0)
    got = outbox.received(spark, str(tmp_path), "id long")
    assert sorted(r["id"] for r in got.collect()) == list(range(230))
    sizes = [r["count"] for r in got.groupBy("batch").count().collect()]
    assert max(sizes) <= 25 and len(sizes) == 12  # four partitions of 57 and 58
    with pytest.raises(RuntimeError, match="2 rows are left after 3"):
        outbox.delivered_in_batches([{}, {}], lambda x: x, 3, 0.0)


def test_a_failing_task_sends_nothing_twice(spark, tmp_path):
    rows = spark.range(0, 200, numPartitions=4)
    with pytest.raises(Exception, match="the receiver is gone"):
        outbox.deliver(rows, str(tmp_path), key="id", source=Moody, poison=199, pause=0)
    (tmp_path / "manifests").mkdir(exist_ok=True)
    assert outbox.received(spark, str(tmp_path), "id long").count() == 0
    outbox.deliver(rows, str(tmp_path), key="id", source=Moody, pause=0)
    outbox.deliver(rows.where("id < 10"), str(tmp_path), key="id", source=Moody, pause=0)  # keys that came before
    assert sorted(r["id"] for r in outbox.received(spark, str(tmp_path), "id long").collect()) == list(range(200))


def test_of_rows_of_a_key_the_first_counts(spark, tmp_path):
    for n in range(4):
        for write in range(2):
            outbox.deliver(spark.range(0, 60, numPartitions=3).select("id", F.lit(write).alias("write_no")), str(tmp_path / str(n)), key="id", pause=0)
        got = outbox.received(spark, str(tmp_path / str(n)), "id long, write_no int")
        assert [(r["write_no"], r["count"]) for r in got.groupBy("write_no").count().collect()] == [(0, 60)]
        assert got.select("batch").distinct().count() == 3


def test_a_replayed_micro_batch_is_delivered_once(spark, tmp_path):
    outbox.register(spark)
    for i in range(3):
        spark.range(i * 40, i * 40 + 40).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.format("outbox").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    run()
    for f in (tmp_path / "c" / "commits").iterdir():
        if f.name.strip(".").startswith("2"):
            f.unlink()
    run()
    got = outbox.received(spark, str(tmp_path / "out"), "id long")
    assert sorted(r["id"] for r in got.collect()) == list(range(120)) and len(list((tmp_path / "out" / "manifests").glob("batch-*.json"))) == 3


def table(spark, tmp_path, n=40):
    df = spark.range(n).select(F.concat(F.lit("run-"), F.col("id").cast("string")).alias("run_id"), F.lit("a").alias("step"), F.col("id").alias("total_posts_retrieved"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    t = Snapshots(spark, str(tmp_path / "t")).create(df.schema, ["run_id", "step"], 8)
    t.append(df)
    return t, df


def test_versions(spark, tmp_path):
    t, df = table(spark, tmp_path)
    t.upsert(df.where("total_posts_retrieved < 3").withColumn("total_posts_retrieved", F.lit(100)).union(df.where("total_posts_retrieved = 1")).union(df.limit(1).withColumn("run_id", F.lit(None))), order="total_posts_retrieved")
    t.delete(df.where("total_posts_retrieved >= 38"))
    now = {r["run_id"]: r["total_posts_retrieved"] for r in t.read().collect()}
    assert len(now) == 39 and None in now and now["run-0"] == now["run-1"] == now["run-2"] == 100 and now["run-3"] == 3 and "run-39" not in now
    assert sorted(r["total_posts_retrieved"] for r in t.read(1).collect()) == list(range(40)) and t.read(0).count() == 0
    assert [(h["version"], h["operation"]) for h in t.history()] == [(0, "create"), (1, "append"), (2, "upsert"), (3, "delete")]
    with pytest.raises(ValueError, match="no version 9"):
        t.read(9)
    with pytest.raises(Conflict):
        Snapshots(spark, str(tmp_path / "t")).create(df.schema, ["run_id"])


def test_a_lost_race(spark, tmp_path):
    t, df = table(spark, tmp_path)
    mine, theirs = df.where("run_id = 'run-7'").withColumn("total_posts_retrieved", F.lit(70)), df.where("run_id = 'run-7'").withColumn("total_posts_retrieved", F.lit(77))
    base = t.entry()["version"]
    t.upsert(theirs)
    with pytest.raises(Conflict, match="upsert"):
        t.upsert(mine, base=base)
    assert t.read().where("run_id = 'run-7'").first()["total_posts_retrieved"] == 77 and t.read().count() == 40
    # a key of another bucket commits on top, and an append conflicts with no append
    home = {r["run_id"]: r["b"] for r in df.select("run_id", t._bucket(["run_id", "step"], 8).alias("b")).collect()}
    far = next(k for k, b in home.items() if b != home["run-7"])
    t.upsert(df.where(F.col("run_id") == far).withColumn("total_posts_retrieved", F.lit(500)), base=base)
    now = {r["run_id"]: r["total_posts_retrieved"] for r in t.read().collect()}
    assert now["run-7"] == 77 and now[far] == 500 and len(now) == 40


def test_posts_with_totals(spark, tmp_path):
    runs, df = table(spark, tmp_path)
    batch = spark.range(30).select(F.concat(F.lit("run-"), (F.col("id") % 5).cast("string")).alias("run_id"), F.col("id").alias("seq"))
    posts = Snapshots(spark, str(tmp_path / "posts")).create(batch.schema, ["run_id"], 4)
    append_posts(posts, runs, batch, F.lit("2024-02-01").cast("timestamp"))
    append_posts(posts, runs, batch.where("seq < 5"), F.lit("2024-02-02").cast("timestamp"))
    assert posts.read().count() == 35 and posts.read(1).count() == 30
    assert {r["run_id"]: r["total_posts_retrieved"] for r in runs.read().where("updated_at > '2024-01-02'").collect()} == {f"run-{i}": i + 7 for i in range(5)}
