"""Fixture cases and properties of series, charts, runs and stored rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from moodtide.operators import chart as V
from moodtide.operators import runs as R
from moodtide.operators import series as Q
from moodtide.sources import storage
from moodtide.sources.config import Settings

T0 = dt.datetime(2025, 1, 1)


def series(spark, values, step=dt.timedelta(hours=1)):
    rows = [(f"run-{i}", T0 + i * step, float(v), 100) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, timestamp timestamp, net_sentiment_percent double, total_posts long")


def test_weekly_fixture(spark):
    s = series(spark, [-20, 10, 5, -5, 15])
    r = Q.y_range(s).first()
    assert (r["y_min"], r["y_max"], r["center"]) == (-25, 20, -2.5) and abs(r["scale"] - 200 / 45) < 1e-12
    stats = Q.series_stats(s).first()
    assert (stats["current"], stats["average"], stats["trend"], stats["lowest"]) == (15, 1.0, 35, -20)
    assert Q.latest_is_extreme(s).first()["extreme"] == "Highest"
    assert [x["color"] for x in Q.segments(s).orderBy("from_ts").collect()] == ["negative", "neutral", "neutral", "neutral"]


def test_empty_and_single(spark):
    assert tuple(Q.y_range(series(spark, [])).first()) == (-100.0, 100.0, 0.0, 1.0)
    assert Q.with_position(series(spark, [5])).first()["position"] is None
    with pytest.raises(ValueError, match="no data points provided"):
        V.svg(series(spark, []))
    assert V.svg(series(spark, [50.0])).startswith("<svg")


def test_smoothing(spark):
    got = [r["smoothed"] for r in Q.gaussian_smooth(series(spark, [10, 20, 30, 40, 50]), 2.0).orderBy("ts").collect()]
    want = [22.244279442177874, 25.916975192458686, 30.0, 34.083024807541314, 37.755720557822116]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9
    assert [r["smoothed"] for r in Q.gaussian_smooth(series(spark, [10]), 2.0).collect()] == [10]
    assert Q.gaussian_smooth(series(spark, []), 2.0).count() == 0
    assert all(abs(r["smoothed"] - 7) < 1e-9 for r in Q.gaussian_smooth(series(spark, [7] * 40), 4.0).collect())


def test_day_borders(spark):
    d = dt.datetime(2025, 1, 2)
    rows = [("r", t, 1.0, 1) for t in (d, d + dt.timedelta(milliseconds=1), d + dt.timedelta(days=1, milliseconds=-1), d + dt.timedelta(days=1))]
    s = spark.createDataFrame(rows, "run_id string, timestamp timestamp, net_sentiment_percent double, total_posts long")
    assert Q.day_window(s, F.lit(d).cast("timestamp")).count() == 2
    assert {str(r["date"]): r["total_runs"] for r in Q.daily_rollup(s).collect()} == {"2025-01-02": 3, "2025-01-03": 1}
    assert {str(r["date"]): r["total_runs"] for r in Q.daily_rollup(s, compat=True).collect()} == {"2025-01-02": 2}


def test_gap_severities(spark):
    minutes = [0, 35, 71, 116, 162, 223, 344]
    runs = spark.createDataFrame([(f"r{i}", T0 + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)], "run_id string, created_at timestamp")
    assert [r["severity"] for r in R.run_gaps(runs).orderBy("to_ts").collect()] == ["LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert R.max_gap(runs).first()["gap_minutes"] == 121


def test_batches_add_up(spark):
    posts = spark.createDataFrame([("r", i, i % 7) for i in range(300)], "run_id string, seq long, likes long")
    items = R.batches(posts)
    assert sorted(r["post_id"] for r in items.collect()) == ["r#batch0", "r#batch1", "r#batch2"]
    assert R.run_posts(items, "r").count() == 300
    assert R.max_batch_index(items).first()["max_batch"] == 2


def test_daily_upsert_and_history_append(spark, tmp_path):
    now = F.lit("2025-02-01 00:00:00").cast("timestamp")
    daily = Q.daily_rollup(series(spark, range(48)))
    for _ in range(2):  # the second write replaces the same days
        storage.upsert_daily(daily, str(tmp_path / "daily"), now)
    back = spark.read.parquet(str(tmp_path / "daily"))
    assert back.count() == 2 and back.agg(F.sum("total_runs")).first()[0] == 48
    storage.append_history(series(spark, range(3)), str(tmp_path / "h"), now)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 3


def test_bad_json_lines_are_skipped(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    from pyspark.sql import types as T

    got = storage.read_jsonl(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(r["a"] for r in got.collect()) == [1, 2]


def test_paged_source(spark, tmp_path):
    import json

    from moodtide.sources import pages

    for page in range(3):
        lines = [json.dumps({"uri": f"at://{page}-{i}", "text": "x", "seq": page * 100 + i, "likes": None}) for i in range(4)]
        (tmp_path / f"page-{page * 100:09d}.jsonl").write_text("\n".join([*lines, "bad line"]))
    pages.register(spark)
    rows = spark.read.format("paged_posts").option("path", str(tmp_path)).option("maxPages", 5).load()
    assert rows.count() == 12 and rows.agg(F.sum("likes")).first()[0] == 0


def test_settings():
    got = Settings.of({"TOP_POSTS_COUNT": "7", "dry_run": "true", "analysis_interval_minutes": "x"})
    assert (got.top_posts_count, got.dry_run, got.analysis_interval_minutes) == (7, True, 60)
