"""A sink that delivers rows to a receiver in small batches, as a data source writer for batches and streams.

Each task sends its rows ``size`` (25) at a time, a batch up to ``attempts`` (5) times with growing pauses; what a receiver refuses is sent again, and what is left after the last attempt fails the
task. A row carries its idempotency key, a hash of the columns ``key`` names (of all, unless given), so a receiver can drop what it has had before.

The receiver of this module is a folder of any file system that Arrow reads. Tasks stage batches there; they count once the write is committed, by one manifest that names them. So a task that fails and runs again,
a job that is aborted and a micro-batch that is replayed under its own number all leave each row delivered once. A network client subclasses ``Outbox`` and gives its own ``receiver``.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from moodtide.sources.pages import _opened, _put

BATCH_SIZE, ATTEMPTS, PAUSE = 25, 5, 0.1


@dataclass
class Sent(WriterCommitMessage):
    """What a task has handed to the receiver."""

    names: list[str]
    rows: int


def delivered_in_batches(items: list[dict], send: Callable[[list[dict]], list[dict]], attempts: int = ATTEMPTS, pause: float = PAUSE) -> int:
    """Sends items until none is refused; the number of attempts. ``send`` returns those that it could not take."""
    left, n = items, 0
    while left and n < attempts:
        if n:
            time.sleep(n * pause)
        left, n = send(left), n + 1
    if left:
        raise RuntimeError(f"{len(left)} rows are left after {attempts} attempts")
    return n


class FolderReceiver:
    """Stages what it is sent as JSON lines; ``finish`` names the file of a batch once all of it is taken."""

    def __init__(self, folder: str, task: str):
        self.io, self.path = _opened(folder)
        self.io.create_dir(f"{self.path}/staged", recursive=True)
        self.task, self.held, self.names = task, [], []

    def send(self, items: list[dict]) -> list[dict]:
        self.held += items
        return []

    def finish(self) -> None:
        name = f"{self.task}-{len(self.names):06d}.json"
        _put(self.io, f"{self.path}/staged/{name}", "\n".join(json.dumps({"_row": i, **x}, default=str) for i, x in enumerate(self.held)).encode())
        self.names.append(name)
        self.held = []


class _Writer:
    def __init__(self, source: Outbox):
        self.source, self.options, self.write_id = source, dict(source.options), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        o, context = {k.lower(): v for k, v in self.options.items()}, TaskContext.get()
        size, attempts, pause = int(o.get("size", BATCH_SIZE)), int(o.get("attempts", ATTEMPTS)), float(o.get("pause", PAUSE))
        key = [x.strip() for x in o["key"].split(",")] if o.get("key") else None
        receiver = self.source.receiver(o["path"], f"{self.write_id}-{context.partitionId():06d}-{context.taskAttemptId()}")
        waiting, rows = [], 0
        for b in iterator:
            for r in b.to_pylist():
                named = json.dumps([r[k] for k in key] if key else r, default=str, sort_keys=True)
                waiting.append({"_key": hashlib.sha256(named.encode()).hexdigest(), **r})
                rows += 1
                if len(waiting) == size:
                    delivered_in_batches(waiting, receiver.send, attempts, pause)
                    receiver.finish()
                    waiting = []
        if waiting:
            delivered_in_batches(waiting, receiver.send, attempts, pause)
            receiver.finish()
        return Sent(receiver.names, rows)

    def _commit(self, messages: list, name: str) -> None:
        io, path = _opened(self.options["path"])
        io.create_dir(f"{path}/manifests", recursive=True)
        at = time.time_ns()
        body = [{"write": name, "name": n, "at": at} for m in messages if m is not None for n in m.names]
        _put(io, f"{path}/manifests/{name}.json", "\n".join(map(json.dumps, body)).encode())

    def _abort(self, messages: list) -> None:
        io, path = _opened(self.options["path"])
        for m in messages:
            for n in m.names if m is not None else ():
                io.delete_file(f"{path}/staged/{n}")


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, f"write-{self.write_id}")

    def abort(self, messages: list) -> None:
        self._abort(messages)


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    """A micro-batch that is replayed replaces its own manifest."""

    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"batch-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._abort(messages)


class Outbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def receiver(self, folder: str, task: str) -> FolderReceiver:
        """What a task sends to: ``send(items)`` returns those refused, ``finish()`` ends a batch, ``names`` holds the ends."""
        return FolderReceiver(folder, task)

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self)


def register(spark: SparkSession, source: type[Outbox] = Outbox) -> None:
    spark.dataSource.register(source)


def deliver(df: DataFrame, folder: str, key: str | None = None, source: type[Outbox] = Outbox, **options) -> None:
    """Sends the rows of df, from all its partitions."""
    from moodtide.session import ship

    ship(df.sparkSession)
    register(df.sparkSession, source)
    writer = df.write.format(source.name()).mode("append").option("path", folder)
    for k, v in (options | ({"key": key} if key else {})).items():
        writer = writer.option(k, str(v))
    writer.save()


def received(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What a folder has received by committed writes: ``_key``, the columns of schema, and the file of the batch. A key that came several times is its first row by
    time of commit, batch and place in it, so that all reads agree."""
    named = spark.read.schema("write string, name string, at long").json(f"{folder}/manifests")
    rows = spark.read.schema(f"_row long, _key string, {schema}").json(f"{folder}/staged").withColumn("batch", F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1))
    columns = [c for c in rows.columns if c not in ("_row", "_key")]
    first = F.min_by(F.struct(*columns), F.struct("at", "batch", "_row")).alias("_first")
    return rows.join(named, rows["batch"] == named["name"]).groupBy("_key").agg(first).select("_key", "_first.*")
