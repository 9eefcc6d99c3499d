"""Copies of folders between file systems as Spark jobs: large files in parts, one commit a file, and a copy that was broken off goes on.

Files up to ``part_bytes`` (100 MB) are one part. Tasks copy ranges, each under a name that says which file (path, size, time of change), which part and what it should hold, and keep its SHA-256; parts that are
there already aren't copied again. Once all are there, a task for each file writes them one after another under another name, checks each against its digest, and moves the file to
its place. A reader of the target sees whole files only. Any file system that Arrow reads will do. Empty files are left out, as in checksums.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.session import ship
from moodtide.sources.pages import _opened, _put

PART_BYTES, CHUNK = 100 << 20, 4 << 20


def files_below(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, changed) of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.unix_micros("modificationTime").alias("changed"))


def _parts(files: DataFrame, root: str, part_bytes: int) -> DataFrame:
    """A row for each part: file, length, parts, part, first, size, name."""
    parts = F.greatest(F.ceil(F.col("length") / part_bytes), F.lit(1)).cast("int")
    rows = files.select("path", "length", F.expr(f"substring(path, {len(root) + 2})").alias("file"), parts.alias("parts"), F.sha2(F.concat_ws("|", "path", "length", "changed", F.lit(part_bytes)), 256).alias("id"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("first", F.col("part").cast("long") * part_bytes)
    return rows.withColumn("size", F.least(F.lit(part_bytes).cast("long"), F.col("length") - F.col("first"))).withColumn("name", F.concat(F.col("id"), F.format_string("-%06d", "part")))


def _copied(target: str):
    """Copies each part of a batch unless it is there with its digest; adds digest and whether it was copied now."""

    def run(batches):
        io, at = _opened(target)
        for b in batches:
            digests, new = [], []
            for r in b.select(["path", "first", "size", "name"]).to_pylist():
                part = f"{at}/_parts/{r['name']}"
                if io.get_file_info(f"{part}.sha256").type == fs.FileType.File and io.get_file_info(part).size == r["size"]:
                    with io.open_input_stream(f"{part}.sha256") as f:
                        digests.append(f.read().decode())
                    new.append(False)
                    continue
                source, path = _opened(r["path"])
                digest, left = hashlib.sha256(), r["size"]
                with source.open_input_file(path) as f, io.open_output_stream(temporary := f"{part}.{uuid.uuid4().hex}") as out:
                    f.seek(r["first"])
                    while left:
                        chunk = f.read(min(CHUNK, left))
                        if not chunk:
                            raise OSError(f"{r['path']} has become shorter")
                        digest.update(chunk)
                        out.write(chunk)
                        left -= len(chunk)
                io.move(temporary, part)
                _put(io, f"{part}.sha256", digest.hexdigest().encode())
                digests.append(digest.hexdigest())
                new.append(True)
            yield pa.record_batch([*(b.column(c) for c in ("file", "length", "parts", "part", "name")), pa.array(digests, pa.string()), pa.array(new, pa.bool_())], names=["file", "length", "parts", "part", "name", "digest", "copied"])

    return run


def _committed(target: str):
    """Joins the parts of each file and moves it to its place."""

    def run(batches):
        io, at = _opened(target)
        for b in batches:
            totals = []
            for r in b.to_pylist():
                final = f"{at}/{r['file']}"
                io.create_dir(final.rpartition("/")[0], recursive=True)
                whole = hashlib.sha256()
                with io.open_output_stream(temporary := f"{final}.{uuid.uuid4().hex}._copying") as out:
                    for p in sorted(r["held"], key=lambda p: p["part"]):
                        digest = hashlib.sha256()
                        with io.open_input_stream(f"{at}/_parts/{p['name']}") as f:
                            while chunk := f.read(CHUNK):
                                digest.update(chunk)
                                whole.update(chunk)
                                out.write(chunk)
                        if digest.hexdigest() != p["digest"]:
                            raise OSError(f"part {p['part']} of {r['file']} differs from what was read")
                io.move(temporary, final)
                totals.append(whole.hexdigest())
            yield pa.record_batch([*(b.column(c) for c in ("file", "length", "parts", "copied")), pa.array(totals, pa.string())], names=["file", "length", "parts", "copied", "checksum"])

    return run


def transfer(spark: SparkSession, source: str, target: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Copies the files below source to target: (file, length, parts, copied, checksum) of each, copied being the parts that this run has copied.

    The rows are those of the job that has run, from a table of the scratch folder: reading them again copies nothing.
    """
    from moodtide.plans.files import written

    ship(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(source)
    root = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")
    io, at = _opened(target)
    io.create_dir(f"{at}/_parts", recursive=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _parts(files_below(spark, source), root, part_bytes).repartition(n, "name")
    parts = written(rows.mapInArrow(_copied(target), "file string, length long, parts int, part int, name string, digest string, copied boolean"), "parts")
    held = F.collect_list(F.struct("part", "name", "digest")).alias("held")  # the parts of one file
    files = parts.groupBy("file", "length", "parts").agg(held, F.count_if("copied").alias("copied"))
    done = written(files.mapInArrow(_committed(target), "file string, length long, parts int, copied long, checksum string"), "files")
    io.delete_dir(f"{at}/_parts")
    return done
