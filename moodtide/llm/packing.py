"""op3: best-fit packing with length patterns fitted by non-negative least squares.

Only the histogram of lengths (as many numbers as a sequence has tokens) meets on the driver. Lengths
are binned; patterns of few bins whose upper edges fill a sequence are enumerated; repeat counts are fitted to the
binned histogram by non-negative least squares and rounded down. A pattern takes the longest pieces of its bins, and for
its last two bins the two pieces that fill the sequence best; it repeats while it fills it, or leaves room of use. What is left over, with
the lengths under 1/32 of a sequence, is packed best-fit decreasing, also into that room. The plan is a list of runs: so many pieces of one
length, one in each of consecutive sequences, at one offset. A piece's rank among those of its length
finds its run; ranks are counted in salted groups, so no length meets in one task.

Null or empty text: one piece, the end id alone. Null doc_ids stay null. Repeated rows and doc_ids are packed each by itself.
Other columns are ignored; no rows give no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodtide.llm import common, tokens
from moodtide.llm import textkit as tk
from moodtide.llm.token_file import tokenizer_path

SIZE, END_ID, BIN, MOST_PARTS, SALTS = 4096, 1, 64, 5, 256
#: Bins up to this part of a sequence are left to fill room; room smaller than a bin is of no use.
FILLERS = 32
#: Text whose ids are made at once: arrays beside the text stay small, as an encoder takes room of its own in each worker.
SLICE_BYTES = 1 << 18
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_rows(tokenizer: str, end_id: int, size: int):
    def rows(batches):
        encoder = tokens.encoder(tokenizer)
        for b in batches:
            ids = b.column("doc_id")
            for t in tk.slices(b.column("text"), limit=SLICE_BYTES):
                values, begin = tokens.with_end(*encoder.encode(t), end_id)
                length = np.diff(begin)
                count = -(-length // size)
                own = np.repeat(np.arange(t.n), count)
                piece = tk.ragged(np.zeros(t.n, np.int64), count)
                start = piece * size
                long = np.minimum(length[own] - start, size)
                raw, at = values.astype("<u4").tobytes(), begin[own] + start
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + long).tolist(), strict=True)]
                yield pa.record_batch([ids.take(pa.array(own + t.first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(long), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b| (active set, Lawson and Hanson)."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(4 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[free] = -1
        j = int(slope.argmax())
        if slope[j] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        free[j] = True
        for _ in range(3 * a.shape[0]):
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                break
            step = min(1.0, float((x[low] / np.maximum(x[low] - s[low], 1e-300)).min()))
            x += step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = np.maximum(s, 0)
    return x


def patterns(bins: int, present: np.ndarray, most: int = MOST_PARTS) -> list[tuple[int, ...]]:
    """Multisets of up to most present bins (numbered from 1) that sum to all bins, largest first."""
    out: list[tuple[int, ...]] = []
    usable = [int(k) for k in np.flatnonzero(present) + 1]

    def grow(left: int, top: int, parts: tuple[int, ...]) -> None:
        if not left:
            out.append(parts)
        elif len(parts) < most:
            for k in usable:
                if k > min(left, top):
                    break
                if k * (most - len(parts)) >= left:
                    grow(left - k, k, (*parts, k))

    grow(bins, bins, ())
    return out


def packing_plan(counts: np.ndarray, size: int = SIZE, width: int = BIN) -> tuple[np.ndarray, int]:
    """Runs (length, first sequence, pieces, offset) that place counts[k] pieces of length k, and the number of sequences."""
    runs, sequences, left, room = pattern_runs(counts, size, width)
    return _best_fit(left, size, runs, sequences, room)


def pattern_runs(counts: np.ndarray, size: int = SIZE, width: int = BIN) -> tuple[list, int, np.ndarray, list]:
    """Runs of the fitted patterns, their sequences, the pieces they leave, and the room (space, first sequence, sequences)."""
    bins = -(-size // width)
    binned = np.add.reduceat(counts[1:], np.arange(0, size, width)).astype(float)
    fitted = np.where(np.arange(1, bins + 1) * width * FILLERS > size, binned, 0)
    some = patterns(bins, fitted > 0)
    matrix = np.zeros((bins, len(some)))
    for j, p in enumerate(some):
        for k in p:
            matrix[k - 1, j] += 1
    repeats = np.floor(nnls(matrix, fitted) + 1e-9).astype(np.int64) if some else np.zeros(0, np.int64)
    left, runs, sequences, room = counts.astype(np.int64).copy(), [], 0, []
    for p, wanted in zip(some, repeats.tolist(), strict=True):
        while wanted > 0:
            lengths = _pieces(p, left, size, width)
            space = size - sum(lengths)
            if len(lengths) < len(p) or 0 < space < width:
                break
            need = {length: lengths.count(length) for length in lengths}
            n = min(wanted, *(int(left[length]) // m for length, m in need.items()))
            at = 0
            for length in lengths:
                runs.append((length, sequences, n, at))
                left[length] -= n
                at += length
            if space:
                room.append((space, sequences, n))
            sequences, wanted = sequences + n, wanted - n
    return runs, sequences, left, room


def _pieces(pattern: tuple[int, ...], left: np.ndarray, size: int, width: int) -> list[int]:
    """Lengths for a pattern's bins: the longest that are left, the last two chosen to fill the sequence best. Fewer if some bin has none."""
    out: list[int] = []

    def longest(k: int, most: int) -> int:
        return next((x for x in range(min(most, size), (k - 1) * width, -1) if left[x] > out.count(x)), 0)

    for i, k in enumerate(pattern):
        space = size - sum(out)
        if i == len(pattern) - 2:
            best = (space + 1, 0)
            for x in range(min(k * width, size), (k - 1) * width, -1):
                if left[x] > out.count(x):
                    out.append(x)
                    y = longest(pattern[-1], space - x)
                    out.pop()
                    if y and space - x - y < best[0]:
                        best = (space - x - y, x)
                    if not best[0]:
                        break
            length = best[1]
        else:
            length = longest(k, space if i == len(pattern) - 1 else k * width)
        if not length:
            break
        out.append(length)
    return out


def _best_fit(left: np.ndarray, size: int, runs: list, sequences: int, spaces: list) -> tuple[np.ndarray, int]:
    """The runs, and those of the pieces that are left: longest first, each into the smallest room that holds it."""
    room: dict[int, list[tuple[int, int]]] = {}
    open_room: list[int] = []

    def leave(space: int, first: int, n: int) -> None:
        if space not in room:
            room[space] = []
            insort(open_room, space)
        room[space].append((first, n))

    for x in spaces:
        leave(*x)
    for length in range(size, 0, -1):
        m = int(left[length])
        while m:
            i = bisect_left(open_room, length)
            if i == len(open_room):
                n = -(-m // (size // length))
                first, space, sequences = sequences, size, sequences + n
            else:
                space = open_room[i]
                first, n = room[space].pop()
                if n > m:
                    room[space].append((first + m, n - m))
                if not room[space]:
                    del room[space]
                    open_room.pop(i)
            n = min(n, m)
            runs.append((length, first, n, size - space))
            m -= n
            if space > length:
                leave(space - length, first, n)
    return np.array(runs, np.int64).reshape(-1, 4), sequences


def placed(plan: np.ndarray):
    """Adds sequence_id and offset to rows with a length and their rank among those of that length."""
    by = np.lexsort((np.arange(len(plan)), plan[:, 0]))
    plan = plan[by]
    before = np.cumsum(plan[:, 2]) - plan[:, 2]  # pieces of all runs before, shorter lengths included
    first = np.searchsorted(plan[:, 0], np.arange(plan[:, 0].max() + 2 if len(plan) else 1))
    base = np.append(before, plan[:, 2].sum())[first]

    def rows(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = base[length] + rank
            run = np.searchsorted(before, at, "right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*cols, pa.array(plan[run, 1] + at - before[run]), pa.array(plan[run, 3])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = SIZE, salts: int = SALTS) -> DataFrame:
    common.ship(docs.sparkSession)
    pieces = common.written(docs.select("doc_id", "text").mapInArrow(common.lean(piece_rows(tokenizer, end_id, size), encoders=True), PIECES), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most size rows
        counts[r["length"]] = r["count"]
    plan, _ = packing_plan(counts, size)
    salts = max(salts, int(counts.sum()) // 1_000_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    ahead = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    ahead = ahead.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(ahead, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(common.lean(placed(plan)), PIECES + ", sequence_id long, offset long")


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
