"""Pages end at the cutoff, at a missing page, or with a warning at maxPages."""

import datetime as dt
import json

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from moodtide.sources import pages


@pytest.fixture
def folder(tmp_path):
    for page in [0, 1, 2, 3, 5]:
        lines = [json.dumps({"uri": f"at://{page}-{i}", "seq": page * 100 + i, "created_at": f"2024-01-01T{10 - page:02d}:0{i}:00Z"}) for i in range(4)]
        (tmp_path / f"page-{page * 100:09d}.jsonl").write_text("\n".join(lines))
    return str(tmp_path)


def cursors(**options):
    return [p.value for p in pages.PagesReader(options).partitions()]


def test_batch_ends(spark, folder):
    assert cursors(path=folder) == [0, 100, 200, 300]
    assert cursors(path=folder, cutoff="2024-01-01T09:02:00Z") == [0, 100]
    assert cursors(path=folder, cutoff="2024-01-01T18:02:00+09:00") == [0, 100]
    with pytest.warns(UserWarning, match="maxPages = 2"):
        assert cursors(path=folder, maxPages="2") == [0, 100]
    with pytest.raises(ValueError, match="cutoff"):
        cursors(path=folder, cutoff="yesterday")
    pages.register(spark)
    assert spark.read.format("paged_posts").option("path", folder).option("cutoff", "2024-01-01T09:02:00Z").load().count() == 8


def test_stream_ends(folder, tmp_path):
    stream = pages.PagesStream({"path": folder, "cutoff": "2024-01-01T09:02:00Z", "state": str(tmp_path / "s1")})
    start, end = stream.initialOffset(), stream.latestOffset()
    parts = stream.partitions(start, end)
    assert sum(b.num_rows for p in parts for b in stream.read(p)) == 8
    assert stream.latestOffset() == end and stream.partitions(end, end) == []
    again = pages.PagesStream({"path": folder, "cutoff": "2024-01-01T09:02:00Z", "state": str(tmp_path / "s1")})
    assert again.latestOffset() == end
    free = pages.PagesStream({"path": folder, "state": str(tmp_path / "s2")})
    assert free.latestOffset()["cursor"] == 400
    with pytest.raises(ValueError, match="state"):
        pages.PagesStream({"path": folder})


def posts(spark, n, start="2024-01-01", labels=False):
    df = spark.range(n).select(
        F.concat(F.lit("at://"), F.col("id").cast("string")).alias("uri"), F.lit("c").alias("cid"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("author"), F.col("id").alias("likes"), F.lit(0).alias("reposts"),
        F.lit(None).cast("long").alias("replies"), F.date_format(F.lit(start).cast("timestamp") + F.make_dt_interval(mins=F.col("id")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"), F.col("id").alias("seq"),
    )
    return df.withColumn("labels", F.when(F.col("seq") % 10 == 0, F.array(F.lit("porn"))).otherwise(F.array(F.lit("other")))) if labels else df


def test_zone_map_and_pushed_filters(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "pages")
    assert pages.write_pages(posts(spark, 25_050, labels=True), folder) == 251
    assert [(z.first, z.last, z.rows) for _, z in pages.zone_map(folder)] == [(0, 10_000, 10_000), (10_000, 20_000, 10_000), (20_000, 25_100, 5_050)]
    monkeypatch.setattr(pages, "read_page", lambda *_: pytest.fail("the driver reads no page"))
    at = lambda i: (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)).strftime("%Y-%m-%dT%H:%M:%S.000000Z")
    reader = pages.PushingReader({"path": folder, "maxPages": "1000"})
    assert [p.first for p in reader.partitions()] == [0, 10_000, 20_000]
    left = list(reader.pushFilters([D.GreaterThanOrEqual(("created_at",), at(12_345)), D.LessThan(("created_at",), at(12_400)), D.StringContains(("text",), "9"), D.IsNotNull(("created_at",))]))
    assert [type(f) for f in left] == [D.StringContains, D.IsNotNull] and [p.first for p in reader.partitions()] == [10_000]
    cut = pages.PagesReader({"path": folder, "maxPages": "1000", "cutoff": "2023-12-31"})
    assert [(p.first, p.last) for p in cut.partitions()] == [(0, 10_000), (10_000, 20_000), (20_000, 25_100)]
    monkeypatch.undo()
    pages.register(spark)
    load = lambda push: spark.read.format("paged_posts").option("path", folder).option("maxPages", "1000").option("skipLabels", "porn").option("pushFilters", push).load()
    some = load("true").where((F.col("created_at") >= at(12_345)) & (F.col("created_at") < at(12_400)) & F.col("seq").isin(12_350, 12_351, 12_399, 99))
    assert sorted(r["seq"] for r in some.collect()) == [12_351, 12_399]
    plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(created_at" in plan.split("PushedFilters")[1]
    df = load("false")
    assert df.where("seq = 11").count() == 1 and df.count() == 25_050 - 2_505 and df.where("replies = 0").count() == df.count()


def test_newest_first_ends_in_a_group(spark, tmp_path):
    folder, n = str(tmp_path / "pages"), 12_000
    newest = posts(spark, n).withColumn("seq", n - 1 - F.col("seq"))
    pages.write_pages(newest, folder)
    pages.register(spark)
    cutoff = (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n - 150)).isoformat()
    got = spark.read.format("paged_posts").option("path", folder).option("maxPages", "1000").option("cutoff", cutoff).load()
    assert got.count() == 200  # the page that the cutoff is in is read as a whole


def test_stream_with_a_budget(spark, tmp_path, monkeypatch):
    folder, state = str(tmp_path / "pages"), str(tmp_path / "state")
    pages.write_pages(posts(spark, 3_000), folder)
    now = [1000.0]
    monkeypatch.setattr(pages.time, "time", lambda: now[0])
    stream = pages.PagesStream({"path": folder, "maxPages": "7", "state": state})
    at, read = stream.initialOffset(), []
    for step in range(6):
        end = stream.latestOffset()
        read.append(sum(b.num_rows for p in stream.partitions(at, end) for b in stream.read(p)))
        at = end
        now[0] += 600 if step else 1
    # over 14 minutes with 700 rows would go on; with over 1,000 it ends
    assert read == [700, 700, 700, 0, 0, 0] and at["done"]
    assert pages.PagesStream({"path": folder, "maxPages": "7", "state": state}).latestOffset()["done"]


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    from moodtide.streaming import history as H

    folder = str(tmp_path / "pages")
    pages.write_pages(posts(spark, 1_050), folder)
    pages.register(spark)
    run = lambda: H.append_once(spark.readStream.format("paged_posts").option("path", folder).option("state", str(tmp_path / "state")).option("maxPages", "4").load().select("seq"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
    for f in (tmp_path / "c" / "commits").iterdir():
        f.unlink()  # as if the run had died before it could say so
    for _ in range(4):
        run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["seq"] for r in got.collect()) == list(range(1_050))
