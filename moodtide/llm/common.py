"""Session helpers: inputs, tables written to the shared folder, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import textkit
from moodtide.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if all run in one process."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        wanted = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(wanted)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and lost executors lose nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, which nothing will read again."""
    for t in tables:
        at = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_path)
        at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, a: str = "a", r: str = "r") -> DataFrame:
    """docs with a row's key: doc_id (a hash of the text where null), and 31 bits of that hash (and a flag of the null above them)."""
    h = F.xxhash64("text")
    return docs.withColumn(a, F.coalesce(F.col("doc_id").cast("long"), h)).withColumn(r, h.bitwiseAND(0x7FFFFFFF) + F.when(F.col("doc_id").isNull(), F.lit(1 << 31)).otherwise(F.lit(0)))


def row_place(a: str = "a", r: str = "r") -> Column:
    """A row's place by its key, null doc_ids last, as one number, of which minima need no sort."""
    last = F.lit(1 << 62).cast("decimal(20,0)") * F.lit(1 << 36).cast("decimal(12,0)")
    return F.col(a).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col(r) + F.when(F.col(r) >= 1 << 31, last).otherwise(F.lit(0).cast("decimal(20,0)"))


def lean(rows, encoders: bool = False):
    """rows for mapInArrow, run without what other operators keep in the worker, but for the encoders where rows needs them; freed memory goes back when a task ends.

    Workers are used again and again: what each of them holds on to adds up to a good part of an executor.
    """

    def run(batches):
        if not encoders and (tokens := sys.modules.get("moodtide.llm.tokens")) is not None:
            tokens.forget()
        try:
            yield from rows(batches)
        finally:
            textkit.forget()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


#: Bits of a filter of keys, 8 MB, in rows of 2**15 bits.
FILTER_BITS = 26


def probably_among(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """df without most rows whose columns are in no row of keys: a join of what is left moves few of its wide rows.

    The filter that is broadcast has at most 2**FILTER_BITS bits, whatever the number of keys.
    """
    cell, names = F.xxhash64(*columns).bitwiseAND((1 << FILTER_BITS) - 1), df.columns
    cells = keys.select(cell.alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("filter_row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("filter_bits"))
    rows = df.withColumn("filter_row", F.bitmap_bucket_number(cell)).withColumn("filter_at", F.bitmap_bit_position(cell)).join(F.broadcast(cells), "filter_row")
    byte = F.conv(F.hex(F.substring("filter_bits", (F.col("filter_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.where(F.getbit(byte, (F.col("filter_at") % 8).cast("int")) == 1).select(*names)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def reduce_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A graph of so many edges at most, 16 MB of numbers, is solved in one task; larger ones in rounds of joins. The result is the same.
EDGES_IN_TASK = 1 << 20


def _united(batches):
    """(node, component) of all nodes of edges (v, u): the larger of two roots takes the smaller as its own, until none is left to be taken."""
    rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if rows is None:
        return
    n = rows.num_rows
    ends = pa.chunked_array([*rows["v"].chunks, *rows["u"].chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[ends.indices.to_numpy()]
    v, u, root = at[:n], at[n:], np.arange(len(order))
    while True:
        a, b = root[v], root[u]
        on = a != b
        if not on.any():
            break
        v, u, a, b = v[on], u[on], a[on], b[on]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    yield pa.record_batch([ends.dictionary.take(pa.array(order)), ends.dictionary.take(pa.array(order[root]))], names=["node", "component"])


def connected_components(edges: DataFrame, python: bool = True) -> DataFrame:
    """(node, component) of every node of edges(src, dst); component is the smallest node it reaches.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). The minima of
    large stars are partial aggregates that are written and joined back, so that a hub's rows may be split over tasks. Rounds end when every
    component is a star around its smallest node; each round is written to the shared folder, and deleted after the next. Nulls and loops are dropped.
    A graph of at most ``EDGES_IN_TASK`` edges needs no rounds, unless ``python`` is false.
    """
    e = edges.select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).where("v <> u").distinct()
    e = written(e, "edges")
    if not python or e.count() > EDGES_IN_TASK:
        return _in_rounds(e)
    kind = e.schema["v"].dataType.simpleString()
    out = written(e.coalesce(1).mapInArrow(lean(_united), f"node {kind}, component {kind}"), "components")
    discard(e)
    return out


def _in_rounds(e: DataFrame) -> DataFrame:
    while True:
        # no star: a node below two others, or below one and above another
        ends = e.select(F.col("v").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select("u", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("below").alias("b"), F.max("above").alias("a")).where("b > 1 OR b = 1 AND a = 1").isEmpty():
            break
        both = e.union(e.select("u", "v")).toDF("x", "y")
        low = smallest = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "low")
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", "m")).where("v <> u").distinct()
        before, e = e, written(small, "edges")
        discard(before, smallest)
    out = e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select("u", "u").distinct())
    out.written_path = e.written_path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs whose results are written: it does so once its handles on them are collected, which takes a second round where listeners held them."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
