"""op5: token-id files with Simple-8b words.

A shard is a range of doc_ids in ascending order. It begins with a magic string, holds blocks, and ends
with the place of each block, their number and the magic again; a block is a header of five 64-bit
numbers (documents, ids, words, literals, first document's number in the shard), then doc_ids, a byte for each
that tells whether it is null, ids per document, 64-bit words and literals. The top four bits of a word
select how many values of how many bits it holds; selector 0 holds the number of a literal, the escape for
values of over 60 bits. All is little-endian. Blocks are read one by one, and each selector's words are decoded together.

Null text is an empty document (only the end id); rows of one doc_id stay apart, in the order of their
text's hash; null doc_ids come first. No rows: one shard without blocks or none, and an empty result.
Other columns are ignored. Shards are written under another name and then moved: a repeated task replaces its own file.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import common, tokens
from moodtide.llm import textkit as tk

#: Bytes of text for each shard; small inputs have one for each shuffle partition.
SHARD_BYTES = 1 << 30
MAGIC = b"S8BFILE1"
#: Values and bits of each selector from 1.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_U = np.uint64
_LIMITS = np.array([1 << k for k in range(64)], np.uint64)
_COUNT = np.array([1, *(n for n, _ in SELECTORS)], np.int64)


def encode_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and literals of unsigned values; each word takes as many values as any selector can from there."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return v, v
    bits = np.maximum(np.searchsorted(_LIMITS, v, "right"), 1).astype(np.uint8)
    widest = {1: bits}
    for w in (2, 4, 8, 16, 32):
        if w <= n:
            half = widest[w // 2]
            widest[w] = np.maximum(half[: -(w // 2)], half[w // 2 :])
    choice = np.zeros(n, np.int8)
    for s in range(len(SELECTORS), 0, -1):
        count, b = SELECTORS[s - 1]
        if count <= n:
            w = 1 << (count.bit_length() - 1)
            a = widest[w]
            most = np.maximum(a[: n - count + 1], a[count - w : n - w + 1])
            choice[: n - count + 1][most <= b] = s
    step, at, starts = _COUNT[choice].tolist(), 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    kind = choice[starts]
    out = np.zeros(len(starts), np.uint64)
    literals = v[starts[kind == 0]]
    out[kind == 0] = np.arange(len(literals), dtype=np.uint64)
    for s, (count, b) in enumerate(SELECTORS, 1):
        of = np.flatnonzero(kind == s)
        word = np.full(len(of), s << 60, np.uint64)
        for j in range(count):
            word |= v[starts[of] + j] << _U(b * j)
        out[of] = word
    return out, literals


def decode_words(words: np.ndarray, literals: np.ndarray) -> np.ndarray:
    kind = (words >> _U(60)).astype(np.int64)
    place = np.append(0, np.cumsum(_COUNT[kind]))
    out = np.zeros(place[-1], np.uint64)
    of = np.flatnonzero(kind == 0)
    out[place[of]] = literals[words[of].astype(np.int64)]
    for s, (count, b) in enumerate(SELECTORS, 1):
        of = np.flatnonzero(kind == s)
        for j in range(count):
            out[place[of] + j] = (words[of] >> _U(b * j)) & _U((1 << b) - 1)
    return out


def block_bytes(ids: np.ndarray, length: np.ndarray, doc_id: np.ndarray, null: np.ndarray, first: int) -> bytes:
    words, literals = encode_words(ids)
    head = np.array([len(doc_id), len(ids), len(words), len(literals), first], "<u8")
    return b"".join(x.tobytes() for x in (head, doc_id.astype("<i8"), null.astype(np.uint8), length.astype("<u8"), words.astype("<u8"), literals.astype("<u8")))


def read_block(f) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, ids per document, doc_ids and their nulls of the block at the file's position."""
    docs, ids, n_words, n_literals, _ = (int(x) for x in np.frombuffer(f.read(40), "<u8"))
    doc_id, null, length = np.frombuffer(f.read(8 * docs), "<i8"), np.frombuffer(f.read(docs), np.uint8), np.frombuffer(f.read(8 * docs), "<u8")
    out = decode_words(np.frombuffer(f.read(8 * n_words), "<u8"), np.frombuffer(f.read(8 * n_literals), "<u8"))
    if len(out) != ids:
        raise ValueError("a block's words don't hold as many ids as its header says")
    return out, length.astype(np.int64), doc_id, null.astype(bool)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a folder that all executors share, and the path in it."""
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> list[dict]:
    """Writes docs(doc_id, text) and returns one row for each shard, in their order."""

    def shard(batches):
        number, io, path = TaskContext.get().partitionId(), *file_system(folder)
        final, places, docs_n, ids_n = f"{path}/shard-{number:06d}.s8b", [], 0, 0
        temporary = f"{final}.{uuid.uuid4().hex}"
        encoder = tokens.encoder(tokenizer)
        with io.open_output_stream(temporary) as f:
            f.write(MAGIC)
            for b in batches:
                ids = b.column("doc_id")
                for t in tk.slices(b.column("text")):
                    own = ids.slice(t.first, t.n)
                    values, begin = tokens.with_end(*encoder.encode(t), end_id)
                    places.append(f.tell())
                    f.write(block_bytes(values, np.diff(begin), pc.fill_null(own, 0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False), docs_n))
                    docs_n, ids_n = docs_n + t.n, ids_n + len(values)
            f.write(np.array([*places, len(places)], "<u8").tobytes() + MAGIC)
        io.move(temporary, final)
        yield pa.record_batch({"shard": pa.array([number], pa.int32()), "path": [final], "n_docs": pa.array([docs_n], pa.int64()), "n_ids": pa.array([ids_n], pa.int64())})

    common.ship(docs.sparkSession)
    io, path = file_system(folder)
    io.create_dir(path, recursive=True)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(common.reduce_partitions(docs.sparkSession), size // SHARD_BYTES)
    ranged = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    # a row for each shard of about SHARD_BYTES of text
    return sorted((r.asDict() for r in ranged.mapInArrow(shard, "shard int, path string, n_docs long, n_ids long").collect()), key=lambda r: r["shard"])


def read_shards(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the shards, from their bytes."""
    rows, start = [], 0
    for s in shards:
        rows.append((s["path"], start))
        start += s["n_ids"]

    def read(batches):
        io, _ = file_system(folder)
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                with io.open_input_file(path) as f:
                    size = f.size()
                    f.seek(size - 16)
                    count, tail = int(np.frombuffer(f.read(8), "<u8")[0]), f.read(8)
                    f.seek(size - 16 - 8 * count)
                    places = np.frombuffer(f.read(8 * count), "<u8").tolist()
                    f.seek(0)
                    if tail != MAGIC or f.read(8) != MAGIC:
                        raise ValueError(f"{path} isn't a whole token file")
                    for place in places:
                        f.seek(place)
                        ids, length, doc_id, null = read_block(f)
                        raw, edges = ids.astype("<u4").tobytes(), np.append(0, np.cumsum(length))
                        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                        yield pa.record_batch([pa.array(doc_id.astype(np.int64), mask=null), pa.array(base + edges[:-1]), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        base += int(edges[-1])

    return spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    folder = folder or f"{common.shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_shards(docs.sparkSession, folder, write_shards(docs, folder, tokenizer, end_id))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
