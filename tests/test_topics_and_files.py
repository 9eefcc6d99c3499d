"""Topics of every post, and checksums of files of real rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from moodtide.plans.queries import QUERIES
from moodtide.sources import storage
from moodtide.sources.config import Settings


def test_topics_of_posts(spark, tmp_path):
    d = str(tmp_path)
    rows = [(0, "New #AI and crypto"), (1, "nothing here"), (2, "science! #music"), (3, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, toxic long").write.parquet(f"{d}/labels.parquet")
    spark.range(4).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts")).write.parquet(f"{d}/events.parquet")
    got = {r["id"]: r["topics"] for r in QUERIES["extract_topics_posts"](spark, d).collect()}
    assert len(got) == 11 + 4
    assert [got[100 + i] for i, _ in rows] == ["#ai|artificial intelligence|cryptocurrency", "", "#music|music|science", ""]


def test_checksums_of_small_and_large_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"\n")
    (tmp_path / "b").write_bytes(b"x" * 100_000)
    want = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in "ab"}
    for limit in (1 << 20, 10):
        monkeypatch.setattr(storage, "WHOLE_FILE", limit)
        assert {r["path"][-1]: r["checksum"] for r in storage.list_objects(spark, str(tmp_path)).collect()} == want


def test_restore_goes_by_the_manifest(spark, tmp_path):
    folder, rows = str(tmp_path / "b"), spark.range(5).select(F.col("id").cast("string").alias("run_id"))
    storage.backup({"t": rows}, folder, F.lit("2024-01-01").cast("timestamp"))
    assert storage.restore(spark, folder, "t", rows.schema, str(tmp_path / "into")).count() == 5 and spark.read.parquet(str(tmp_path / "into")).count() == 5
    with pytest.raises(ValueError, match="not found in backup manifest"):
        storage.restore(spark, folder, "u", rows.schema)
    storage.write_jsonl(spark.range(6).select(F.col("id").cast("string").alias("run_id")), f"{folder}/t", gzip=True)
    with pytest.raises(ValueError, match="differ"):
        storage.restore(spark, folder, "t", rows.schema)


def test_settings_of_files_environment_and_stores(tmp_path):
    (tmp_path / "c.yaml").write_text("# all\nsource:\n  handle: x\nsettings:\n  top_posts_count: 9 # most\n  dry_run: true\n  language: 'de'\n  min_engagement_score: many\n")
    got = Settings.of_file(str(tmp_path / "c.yaml"))
    assert (got.top_posts_count, got.dry_run, got.language, got.min_engagement_score, got.analysis_interval_minutes) == (9, True, "de", 10, 60)
    assert Settings.of_environment({"DRY_RUN": "true", "TOP_POSTS_COUNT": ""}) == Settings(dry_run=True)
    assert Settings.of_store(lambda names: {n: "3" for n in names if n.endswith("count")}, "/app/settings").top_posts_count == 3
