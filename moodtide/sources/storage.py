"""Files and tables: posts, JSON lines, manifests, backup and restore, keyed sinks. All paths are Hadoop paths."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodtide import schemas
from moodtide.functions.text import backup_stamp


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """API pages as JSON lines; a line that can't be read gives nulls, which later filters drop."""
    return spark.read.schema(schemas.POST_RAW).option("mode", "PERMISSIVE").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, gzip by suffix; bad lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


#: Files up to this many bytes are read as one value; larger ones in parts.
WHOLE_FILE = 256 << 20


def list_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of each file below a folder; empty files are left out. Files over WHOLE_FILE are read in parts by the tasks, through Arrow's file systems."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    small = files.where(F.col("length") <= WHOLE_FILE).select("path", "length", F.sha2("content", 256).alias("checksum"))

    def digests(batches):
        for b in batches:
            out = []
            for name in b.column("path").to_pylist():
                io, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                digest = hashlib.sha256()
                with io.open_input_stream(at) as f:
                    while part := f.read(8 << 20):
                        digest.update(part)
                out.append(digest.hexdigest())
            yield pa.record_batch([b.column("path"), b.column("length"), pa.array(out, pa.string())], names=["path", "length", "checksum"])

    large = files.where(F.col("length") > WHOLE_FILE).select("path", "length")
    return small.union(large.mapInArrow(digests, "path string, length long, checksum string"))


def checksum_of(files: DataFrame) -> DataFrame:
    """One row: file_size, and the SHA-256 of the files' checksums in order."""
    return files.agg(F.sum("length").alias("file_size"), F.sha2(F.array_join(F.sort_array(F.collect_list("checksum")), "").cast("binary"), 256).alias("checksum"))


def append_partitioned(df: DataFrame, path: str, *keys: str, rows_per_file: int | None = None) -> None:
    w = df.write.mode("append").partitionBy(*keys)
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).parquet(path)


def append_posts(posts: DataFrame, path: str) -> None:
    append_partitioned(posts, path, "run_id")


def with_ttl(df: DataFrame, now: Column, days: int) -> DataFrame:
    return df.withColumns({"created_at": now, "ttl": F.unix_timestamp(now) + days * 86400})


def append_history(history: DataFrame, path: str, now: Column) -> None:
    stamped = with_ttl(history, now, schemas.HISTORY_TTL_DAYS).withColumn("day", F.to_date("timestamp"))
    append_partitioned(stamped, path, "day")


def upsert_daily(daily: DataFrame, path: str, now: Column) -> None:
    """Replaces the days that daily holds, and no other."""
    out = with_ttl(daily, now, schemas.DAILY_TTL_DAYS).withColumn("run_id", F.concat(F.lit("daily-"), F.col("date").cast("string")))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def parse_history_json(rows: DataFrame, now: Column, column: str = "value") -> DataFrame:
    """History rows of JSON strings, stamped anew; rows that can't be read go."""
    parsed = rows.select(F.from_json(column, schemas.HISTORY).alias("h")).where("h.run_id IS NOT NULL").select("h.*")
    return with_ttl(parsed, now, schemas.HISTORY_TTL_DAYS)


def backup(tables: dict[str, DataFrame], folder: str, now: Column, gzip: bool = True, workers: int = 4) -> DataFrame:
    """Writes each table as JSON lines, several at a time, and a manifest of counts, sizes and checksums, which it returns."""
    spark = next(iter(tables.values())).sparkSession

    def one(item: tuple[str, DataFrame]) -> DataFrame:
        name, df = item
        write_jsonl(df, f"{folder}/{name}", gzip)
        files = list_objects(spark, f"{folder}/{name}", "part-*")
        total = checksum_of(files)
        n = spark.read.text(f"{folder}/{name}").agg(F.count("*").alias("item_count"))
        return total.crossJoin(n).select(F.lit(name).alias("table_name"), "item_count", "file_size", F.lit(name).alias("file_name"), "checksum", F.lit("").alias("backup_duration"))  # one row each

    with ThreadPoolExecutor(workers) as pool:
        parts = list(pool.map(one, tables.items()))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    entry = F.struct("table_name", "item_count", "file_size", "file_name", "checksum", "backup_duration")
    manifest = rows.agg(F.sort_array(F.collect_list(entry)).alias("tables"), F.sum("item_count").alias("total_items"))  # a row for each table
    body = manifest.select(backup_stamp(now).alias("backup_timestamp"), F.lit("1.0").alias("backup_version"), "total_items", "tables")
    body = body.withColumn("checksum", F.sha2(F.to_json(F.struct(*body.columns)).cast("binary"), 256))
    body.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return read_manifest(spark, f"{folder}/manifest")


def verified_file(spark: SparkSession, folder: str, table: str) -> str:
    """The file name that a backup's manifest has for a table; an error if it lacks it, or the files differ from what it says."""
    entry = read_manifest(spark, f"{folder}/manifest").select(F.explode("tables").alias("t")).where(F.col("t.table_name") == table).select("t.*").first()
    if entry is None:
        raise ValueError(f"Table {table} not found in backup manifest")
    found = checksum_of(list_objects(spark, f"{folder}/{entry['file_name']}", "part-*")).first()
    if (found["checksum"], found["file_size"]) != (entry["checksum"], entry["file_size"]):
        raise ValueError(f"the files of {table} differ from the backup manifest")
    return entry["file_name"]


def restore(spark: SparkSession, folder: str, table: str, schema: T.StructType, into: str | None = None) -> DataFrame:
    """The rows of a backed-up table, found by the manifest and verified, appended to ``into`` if that is given (else a dry run)."""
    rows = read_jsonl(spark, f"{folder}/{verified_file(spark, folder, table)}", schema)
    if into:
        rows.write.mode("append").parquet(into)
    return rows


def report_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("report"))
