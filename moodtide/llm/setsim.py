"""Exact set-similarity classes of texts at a Jaccard similarity of at least 3/4 on 5-word shingles.

An item is a doc_id. Items of equal sets are one class; a class is named by 64 bits of its set's 128-bit fingerprint
(names that two fingerprints share are told apart).

1. ``keys``: class, size and hashed bitmap of each item. Counts of hashed shingles that are frequent in a task add up to a
   fixed-size table of rarity levels.
2. ``postings``: shingles are ordered by (level, hash), which is one order for all items however good the
   levels are; two sets that link share one of the first n - ceil(3n/4) + 1 of the larger and of the first n - ceil(6n/7) + 1 of the
   smaller. Those prefixes go, as packed arrays, to buckets of shingles. A bucket finds lists of two or more classes, and gives equal
   lists one name.
3. Star: each list's class of most lists is its centre. Lengths and bitmaps bound the overlap with the others; what is left
   is tested by exact intersection, first with the centre of most common lists, then with those still apart. Tests
   come as streams sorted by tile (centre, size band, part), so one large group is many tiles. Each round of tests reads the texts anew
   and moves those of its pairs only, picked by a filter of fixed size.
4. Tiles: of a list whose members are still in several components, those outside its largest one seek partners. Sizes are cut into
   bands, so wide that the sizes a set can link to lie in one or two; a tile is a block of one band of a list and the seekers that can link
   into it, so a member is in one tile and seekers alone are copied. In a tile sizes, then bitmaps bound the overlaps. A pair is
   handed on by the first of its lists alone, as far as the ``FIRST_LISTS`` first lists of each class tell. In ``NEAREST_ROUNDS`` rounds
   each seeker is tested against its nearest one of another component; then against its next 16, then 256, ... nearest ones, until none
   that may still link is left: no round hands on all pairs of a group.

All pairs that share a prefix shingle are so tested, ruled out by a bound, or joined by tested links: components are exact. A
32-bit tag stands for a shingle inside a bucket; clashes only cost tests.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodtide.llm import common
from moodtide.llm import textkit as tk

K, NUM, DEN = 5, 75, 100
#: Width of a size band, in steps of the ratio that links allow.
BAND = 4
SKETCH_BITS, BLOCK_TOKENS, TILE, HELD_PAIRS, NEAREST_ROUNDS = 22, 1_000_000, 512, 500_000, 1
#: Lists of a class that go with its rows, and the factor by which later rounds take more partners of a seeker.
FIRST_LISTS, MORE = 16, 16
#: Bits of a bitmap: the power of two from two for each shingle up, within these bounds.
LEAST_BITS, MOST_BITS = 128, 1 << 20
NAMES = ["a", "r", "n", "h1", "h2", "bits"]
_U = np.uint64
_SECOND = _U(0xA24BAED4963EE407)


def item_words(t: tk.Texts) -> tuple[np.ndarray, ...]:
    """Word hashes, the item of each, and each item's text. Texts without a word are left out."""
    start, end = t.spans(tk.BLANK_SEPARATED)
    begin = np.append(np.searchsorted(start, t.offs[:-1]), len(start))
    count = np.diff(begin)
    full = np.flatnonzero(count)
    return t.hashes(start, end), np.repeat(np.arange(len(full)), count[full]), full


def fingerprints(v: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set of shingles, in any order."""
    return tk.sums(tk.mix(v), edges), tk.sums(tk.mix(v * _SECOND + _U(1)), edges)


def bitmaps(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A hashed bitmap of each set: the parity of the elements of each cell. Widths are powers of two, so that a wide one folds into a narrow one."""
    n = np.diff(edges)
    width = np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    begin = np.append(0, np.cumsum(width))
    cell, count = np.unique(np.repeat(begin[:-1], n) + ((values >> _U(20)).astype(np.int64) & np.repeat(width - 1, n)), return_counts=True)
    on = np.zeros(begin[-1], bool)
    on[cell[count % 2 == 1]] = True
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((begin // 8).astype(np.int32)), pa.py_buffer(np.packbits(on))])


def folded(marks: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words, folded to so many."""
    return np.bitwise_xor.reduce(marks.reshape(len(marks), -1, words), axis=1)


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which the bitmaps of each pair differ, at the narrower one's width."""
    out = np.zeros(len(a), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        kinds.setdefault((len(x), len(y)), []).append(i)
    for (x, y), of in kinds.items():
        words = min(x, y) // 8
        p, q = (folded(np.frombuffer(b"".join(v[i] for i in of), np.uint64).reshape(len(of), -1), words) for v in (a, b))
        out[of] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
    return out


def linked(n1, n2, overlap):
    return DEN * overlap >= NUM * (n1 + n2 - overlap)


def may_link(n1, n2, differing):
    """Whether sets of these sizes whose bitmaps differ in so many bits can link: the overlap's bound from above."""
    return linked(n1, n2, np.minimum((n1 + n2 - differing) // 2, np.minimum(n1, n2)))


def keys(docs: DataFrame) -> DataFrame:
    """(a, r, n, h1, h2, bits) of each row of docs(a, r, text), and the counts h1 of the sketch's cells a in rows whose n is -1."""

    def rows(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            a, r = b.column("a"), b.column("r")
            for t in tk.slices(b.column("text"), lower=True):
                h, item, own = item_words(t)
                bare = np.setdiff1d(np.arange(t.n), own) + t.first
                if len(bare):
                    zero = pa.array(np.zeros(len(bare), np.int64))
                    yield pa.record_batch([a.take(pa.array(bare)), r.take(pa.array(bare)), zero.cast(pa.int32()), zero, zero, pa.nulls(len(bare), pa.binary())], names=NAMES)
                if not len(own):
                    continue
                v, edges = tk.shingle_sets(h, item, len(own), K)
                np.add.at(sketch, (v >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
                h1, h2 = fingerprints(v, edges)
                of = pa.array(own + t.first)
                yield pa.record_batch([a.take(of), r.take(of), pa.array(np.diff(edges).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), bitmaps(v, edges)], names=NAMES)
        hot = np.flatnonzero(sketch >= 8 + 2 * int(sketch.sum(dtype=np.int64)) // (1 << SKETCH_BITS))
        none = np.zeros(len(hot), np.int64)
        yield pa.record_batch([pa.array(hot.astype(np.int64)), pa.array(none), pa.array((none - 1).astype(np.int32)), pa.array(sketch[hot].astype(np.int64)), pa.array(none), pa.nulls(len(hot), pa.binary())], names=NAMES)

    return docs.mapInArrow(common.lean(rows), "a long, r long, n int, h1 long, h2 long, bits binary")


def levels(keyed: DataFrame) -> np.ndarray:
    """Rarity level of each sketch cell; at most 2**SKETCH_BITS rows reach the driver, whatever the input."""
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    hot = keyed.where("n = -1").groupBy("a").agg(F.sum("h1").alias("c")).toArrow()
    if hot.num_rows:
        out[hot["a"].to_numpy()] = np.minimum(np.log2(hot["c"].to_numpy()), 63).astype(np.uint8)
    return out


def shared_names(items: DataFrame) -> dict[tuple[int, int], int]:
    """Other names for classes of which two have the same first 64 bits: about n**2 / 2**65 of n classes, none as a rule."""
    twice = items.groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo <> hi").select("h1")
    names = [r["h1"] for r in twice.collect()]
    clash = items.where(F.col("h1").isin(names)).select("h1", "h2").distinct().collect() if names else []
    return {(r["h1"], r["h2"]): (r["h1"] ^ (r["h2"] * 0x5851F42D4C957F2D)) % 2**63 for r in clash}


def postings(docs: DataFrame, level, buckets: int, renamed: dict) -> DataFrame:
    """Prefix shingles of the classes of each task as packed arrays: (bucket, tags, ids, sizes)."""

    def rows(batches):
        held, size, known = ([], [], []), 0, level.value

        def block():
            tags, ids, n = (np.concatenate(x) for x in held)
            bucket = ((tags >> _U(40)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edge))
            cut = list(zip(edge[some].tolist(), edge[some + 1].tolist(), strict=True))
            packed = (tags[order].astype(np.uint32), ids[order], n[order])
            return pa.record_batch([pa.array(some.astype(np.int32)), *(pa.array([v[x:y].tobytes() for x, y in cut], pa.binary()) for v in packed)], names=["bucket", "tags", "ids", "sizes"])

        for batch in batches:
            for t in tk.slices(batch.column("text"), lower=True):
                h, item, own = item_words(t)
                if not len(own):
                    continue
                v, by = tk.shingles(h, item, len(own), K)
                # one sort puts each set in rarity order; its last bits are the first bits of the hash
                token = (known[v >> _U(64 - SKETCH_BITS)].astype(np.uint64) << _U(58)) | (v >> _U(6))
                token, edges, first = tk.sorted_sets(token, by, len(own), where=True)
                h1, h2 = fingerprints(v[first], edges)
                name = h1.view(np.int64)
                if renamed:
                    name = np.array([renamed.get(k, k[0]) for k in zip(name.tolist(), h2.view(np.int64).tolist(), strict=True)], np.int64)
                _, one = np.unique(name, return_index=True)  # of equal sets in a slice one is enough
                one.sort()
                n = np.diff(edges)[one]
                prefix = n - (NUM * n + DEN - 1) // DEN + 1
                # against sets no smaller than itself a set needs fewer: beyond these its size is negative
                own_prefix = n - (2 * NUM * n + NUM + DEN - 1) // (NUM + DEN) + 1
                at = tk.ragged(edges[one], prefix)
                sign = np.where(tk.ragged(np.zeros(len(n), np.int64), prefix) < np.repeat(own_prefix, prefix), 1, -1)
                for have, x in zip(held, (tk.mix(token[at]), np.repeat(name[one], prefix), (np.repeat(n, prefix) * sign).astype(np.int32)), strict=True):
                    have.append(x)
                size += len(at)
                if size >= BLOCK_TOKENS:
                    yield block()
                    held, size = ([], [], []), 0
        if size:
            yield block()

    return docs.mapInArrow(common.lean(rows), "bucket int, tags binary, ids binary, sizes binary")


def shared_lists(batches):
    """Classes of each list of two or more, from rows sorted by bucket; equal lists of a bucket are emitted once."""
    bucket, held = None, ([], [], [])

    def lists():
        tags, ids, n = (np.frombuffer(b"".join(x), t) for x, t in zip(held, (np.uint32, np.int64, np.int32), strict=True))
        order = np.argsort(tags, kind="stable")
        twice = np.zeros(len(tags) + 1, bool)
        twice[1:-1] = tags[order][1:] == tags[order][:-1]
        order = order[twice[1:] | twice[:-1]]
        if not len(order):
            return None
        order = order[np.lexsort((-n[order], ids[order], tags[order]))]
        tags, ids, n = tags[order], ids[order], n[order]
        new = np.append(True, (tags[1:] != tags[:-1]) | (ids[1:] != ids[:-1]))  # a class may come from several tasks
        tags, ids, n = tags[new], ids[new], n[new]
        edges = np.append(np.flatnonzero(np.append(True, tags[1:] != tags[:-1])), len(tags))
        count = np.diff(edges)
        name = tk.mix(tk.sums(tk.mix(ids.view(np.uint64)), edges) + count.astype(np.uint64))
        # a pair needs an entry of the smaller set's own prefix
        useful = np.flatnonzero((count > 1) & (np.maximum.reduceat(n, edges[:-1]) > 0))
        one = useful[np.unique(name[useful], return_index=True)[1]]
        n = np.abs(n)
        flat = tk.ragged(edges[one], count[one])
        return pa.record_batch([pa.array(np.repeat(name[one], count[one]).view(np.int64)), pa.array(ids[flat]), pa.array(n[flat])], names=["list", "id", "n"])

    for batch in batches:
        for k, *packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tags", "ids", "sizes")), strict=True):
            if k != bucket:
                if bucket is not None and (out := lists()) is not None:
                    yield out
                bucket, held = k, ([], [], [])
            for have, x in zip(held, packed, strict=True):
                have.append(x)
    if bucket is not None and (out := lists()) is not None:
        yield out


def bounded(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of pairs (c, x, xn, ...) that the bitmaps of marks (id, n, bits) leave possible."""
    named = pairs.columns
    both = pairs.join(marks.toDF("c", "c_n", "c_bits"), "c").join(marks.toDF("x", "x_n", "x_bits"), "x")

    def rows(batches):
        for b in batches:
            if b.num_rows:
                ok = may_link(b.column("c_n").to_numpy().astype(np.int64), b.column("x_n").to_numpy().astype(np.int64), differing(b.column("c_bits").to_pylist(), b.column("x_bits").to_pylist()))
                yield b.select(named).filter(pa.array(ok))

    return both.select(*named, "c_n", "c_bits", "x_n", "x_bits").mapInArrow(common.lean(rows), ", ".join(f"{k} {t}" for k, t in pairs.dtypes))


def texts_of(pairs: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """(id, text) of the classes of pairs (c, x): the text of the row that first(id, a, r) names. Other texts are read, but not moved."""
    ids = pairs.select(F.explode(F.array("c", "x")).alias("id")).distinct()
    wanted = common.written(first.select("id", "a", "r").join(ids, "id"), "wanted")
    found = common.probably_among(docs, wanted, ["a", "r"]).join(wanted, ["a", "r"])
    texts = common.written(found.dropDuplicates(["id"]).select("id", "text"), "texts")
    common.discard(wanted)
    return texts


def links_of(pairs: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """Those of pairs (c, x, xn) that link, written: c, x."""
    texts = texts_of(pairs, docs, first)
    out = common.written(tested(pairs, texts), "links")
    common.discard(texts)
    return out


def tested(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (c, x, xn) that link: c, x."""
    band = F.floor(F.log(F.col("xn").cast("double")) / math.log(DEN / NUM)).cast("int")
    large = common.written(pairs.groupBy("c").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")).where("parts > 1"), "large")
    tiles = pairs.join(large, "c", "left").select("c", "x", band.alias("band"), F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    x = tiles.join(texts.toDF("x", "text"), "x").select("c", "band", "part", "x", "text")
    centers = tiles.select("c", "band", "part").distinct().join(texts.toDF("c", "text"), "c").select("c", "band", "part", F.lit(None).cast("long").alias("x"), "text")
    dealt = centers.union(x).repartition(common.reduce_partitions(pairs.sparkSession), "c", "band", "part").sortWithinPartitions("c", "band", "part", F.col("x").asc_nulls_first())

    def test(batches):
        tile, centers = None, []
        for batch in batches:
            col = [batch.column(k).to_pylist() for k in ("c", "band", "part", "x")]
            for t in tk.slices(batch.column("text"), lower=True):
                start, end = t.spans(tk.BLANK_SEPARATED)
                v, edges = tk.shingle_sets(t.hashes(start, end), t.owner(start), t.n, K)
                found = []
                for i in range(t.n):
                    c, band_, part, x = (k[t.first + i] for k in col)
                    own = v[edges[i] : edges[i + 1]]
                    if tile != (c, band_, part):
                        tile, centers = (c, band_, part), []
                    if x is None:
                        centers.append(own.copy())
                    elif any(linked(len(own), len(o), len(np.intersect1d(own, o, assume_unique=True))) for o in centers):
                        found.append((c, x))
                if found:
                    yield pa.record_batch([pa.array(k, pa.int64()) for k in zip(*found, strict=True)], names=["c", "x"])

    return dealt.mapInArrow(common.lean(test), "c long, x long")


def grouped(batches, key: list[str], limit: int):
    """Tables of whole groups of rows that are sorted by key; a group over limit rows comes in parts, flagged."""
    held: list[pa.RecordBatch] = []
    size, broken = 0, None

    def edges(t: pa.Table) -> tuple[int, int]:
        """Where the second and the last group begin."""
        at = np.flatnonzero(np.diff(_groups(t, key), prepend=0))
        return (int(at[0]), int(at[-1])) if len(at) else (t.num_rows, 0)

    def name(t: pa.Table) -> list:
        return [t.column(k)[0].as_py() for k in key]

    def parted(t: pa.Table):
        """t, without what continues a group that came in parts."""
        if broken is not None and name(t) == broken:
            first = edges(t)[0]
            yield t.slice(0, first), False
            t = t.slice(first)
        if t.num_rows:
            yield t, True

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        t = pa.Table.from_batches(held).combine_chunks()
        cut = edges(t)[1]
        if cut:
            yield from parted(t.slice(0, cut))
            held, size, broken = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut, broken if name(t) == broken and name(t.slice(cut)) == broken else None
        elif size > limit:
            yield t, False
            held, size, broken = [], 0, name(t)
    if held:
        yield from parted(pa.Table.from_batches(held).combine_chunks())


def _groups(t: pa.Table, key: list[str]) -> np.ndarray:
    """A number for each run of equal keys."""
    change = np.zeros(t.num_rows, bool)
    for k in key:
        c = t.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def _sizes_around(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most size that a set of size n can link to."""
    return -(-NUM * n // DEN), DEN * n // NUM


class Marks:
    """Bitmaps of a binary column, as matrices by width."""

    def __init__(self, column: pa.ChunkedArray):
        a = column.combine_chunks()
        a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
        offs = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
        data = np.frombuffer(a.buffers()[2], np.uint8)
        self.width, self.row, self.held = np.diff(offs) // 8, np.zeros(len(a), np.int64), {}
        for w in np.unique(self.width).tolist():
            of = np.flatnonzero(self.width == w)
            self.row[of] = np.arange(len(of))
            self.held[w] = data[tk.ragged(offs[of], np.full(len(of), 8 * w))].view(np.uint64).reshape(len(of), w)

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which rows i and j differ, at the narrower one's width."""
        out = np.zeros(len(i), np.int64)
        pair = np.stack([self.width[i], self.width[j]], 1)
        for x, y in np.unique(pair, axis=0).tolist():
            of, w = np.flatnonzero((pair[:, 0] == x) & (pair[:, 1] == y)), min(x, y)
            for at in range(0, len(of), step := max(1, (1 << 20) // w)):
                k = of[at : at + step]
                p, q = folded(self.held[x][self.row[i[k]]], w), folded(self.held[y][self.row[j[k]]], w)
                out[k] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
        return out


def _leading(order: np.ndarray, c: np.ndarray, take: int) -> np.ndarray:
    """Of order, in which equal values of c are neighbours, the first ``take`` of each value."""
    run = np.cumsum(np.append(0, np.diff(c[order]) != 0)[: len(order)])
    return order[np.arange(len(order)) - np.searchsorted(run, run) < take]


def _in_earlier_list(firsts: np.ndarray, lists: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j are known to share a list before that of row i. Rows of firsts hold a class's first lists."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 8192):
        x, y = firsts[i[at : at + 8192]], firsts[j[at : at + 8192]]
        shared = (x[:, :, None] == y[:, None, :]).any(2)
        out[at : at + 8192] = (shared & (x < lists[i[at : at + 8192], None])).any(1)
    return out


def _first_lists(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of FIRST_LISTS names, the last name of all where there are fewer."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    offs = a.offsets.to_numpy()
    size, out = np.diff(offs), np.full((len(a), FIRST_LISTS), np.iinfo(np.int64).max)
    out[np.repeat(np.arange(len(a)), size), tk.ragged(np.zeros(len(a), np.int64), size)] = a.values.to_numpy()[offs[0] : offs[-1]]
    return out


def tile_pairs(take: int, nearest: bool):
    """Of rows sorted by tile: pairs of different components whose bitmaps allow a link; the ``take`` nearest of each seeker, after its cursor.

    Only members outside the list's largest component look for partners: of two components one is not the largest. A task
    combines what its tiles give before it hands it on.
    """

    def combined(held):
        c, x, xn, d = (np.concatenate(k) for k in zip(*held, strict=True))
        order = np.lexsort((x, d, c))
        order = order[np.append(True, (c[order][1:] != c[order][:-1]) | (x[order][1:] != x[order][:-1]))[: len(order)]]
        first = _leading(order, c, take)
        return c[first], x[first], xn[first], d[first]

    def rows(batches):
        held, size = [], 0
        for some in found(batches):
            held.append(some)
            size += len(some[0])
            if size > HELD_PAIRS:
                held = [combined(held)]
                size = len(held[0][0])
                if 2 * size > HELD_PAIRS:
                    yield pa.record_batch([pa.array(k) for k in held[0]], names=["c", "x", "xn", "d"])
                    held, size = [], 0
        if size:
            yield pa.record_batch([pa.array(k) for k in combined(held)], names=["c", "x", "xn", "d"])

    def found(batches):
        for t, _ in grouped(batches, ["list", "band", "block"], 1 << 30):  # about TILE members and the list's seekers
            g, n, ids = _groups(t, ["list", "band", "block"]), t.column("n").to_numpy().astype(np.int64), t.column("id").to_numpy()
            part, asks, seeks, turn, last_d, last_x, lists = (t.column(k).to_numpy(zero_copy_only=False) for k in ("part", "asks", "seeks", "turn", "last_d", "last_x", "list"))
            low, high = _sizes_around(n)
            top = int(high.max()) + 2
            held, seek = np.flatnonzero(~asks), np.flatnonzero(turn)
            held = held[np.argsort((g * top + n)[held], kind="stable")]
            key = (g * top + n)[held]
            begin, end = np.searchsorted(key, g[seek] * top + low[seek]), np.searchsorted(key, g[seek] * top + high[seek], "right")
            marks, firsts = Marks(t.column("bits")), _first_lists(t.column("firsts"))
            pairs = np.cumsum(end - begin)
            at = 0
            while at < len(seek):
                to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + 500_000, "right")))
                i, j = np.repeat(seek[at:to], (end - begin)[at:to]), held[tk.ragged(begin[at:to], (end - begin)[at:to])]
                ok = part[i] != part[j]
                if not nearest:  # a pair that both seek comes once
                    ok &= (ids[i] < ids[j]) | ~seeks[j]
                i, j = i[ok], j[ok]
                d = marks.differing(i, j)
                ok = may_link(n[i], n[j], d) & ((d > last_d[i]) | (d == last_d[i]) & (ids[j] > last_x[i]))
                i, j, d = i[ok], j[ok], d[ok]
                ok = ~_in_earlier_list(firsts, lists, i, j)
                i, j, d = i[ok], j[ok], d[ok]
                first = _leading(np.lexsort((ids[j], d, i)), i, take)
                i, j, d = i[first], j[first], d[first]
                yield ids[i], ids[j], n[j].astype(np.int32), d.astype(np.int32)
                at = to

    return rows


def classes(docs: DataFrame) -> DataFrame:
    """(a, r, n, component_id, stays) of each row of docs(doc_id, text): its key, its set's size, the smallest doc_id of its component, and
    whether it is the first row of its component, by doc_id (null last) and a hash of its text. Without words: n is 0, and it stays.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = common.keyed(docs.select("doc_id", "text")).select("a", "r", "text")
    parts = common.reduce_partitions(spark)
    keyed = common.written(keys(docs), "keys")
    level = spark.sparkContext.broadcast(levels(keyed))
    items = keyed.where("n > 0")
    renamed = shared_names(items)
    items = items.withColumn("id", F.col("h1"))
    if renamed:  # as few rows as names that clash
        other = spark.createDataFrame([(*k, v) for k, v in renamed.items()], "h1 long, h2 long, other long")
        items = items.join(F.broadcast(other), ["h1", "h2"], "left").withColumn("id", F.coalesce("other", "h1")).drop("other")
    place = common.row_place()

    packed = postings(docs, level, 4 * parts, renamed).repartition(parts, "bucket").sortWithinPartitions("bucket")
    raw = common.written(packed.mapInArrow(common.lean(shared_lists), "list long, id long, n int").distinct(), "raw")
    degree = raw.groupBy("id").agg(F.count("*").alias("degree"))
    rank = F.shiftleft(F.least(F.col("degree"), F.lit((1 << 22) - 1)), 40) + F.col("id").bitwiseAND((1 << 40) - 1)
    center = raw.join(degree, "id").groupBy("list").agg(F.max_by("id", rank).alias("c"), F.max_by("n", rank).alias("cn"))
    lists = common.written(raw.join(center, "list"), "lists")
    common.discard(raw)
    # one item of each class that is in a list; copies are combined before they are joined
    low = items.groupBy("id").agg(F.min(place).alias("p")).join(lists.select("id").distinct(), "id", "left_semi")
    first = items.withColumn("p", place).join(low, ["id", "p"]).select("id", "a", "r", "n", "bits").dropDuplicates(["id"])
    first = common.written(first, "first")
    marks = first.select("id", "n", "bits")

    star = lists.where(f"id <> c AND {DEN} * least(cn, n) >= {NUM} * greatest(cn, n)").groupBy("c", F.col("id").alias("x"), F.col("n").alias("xn")).agg(F.count("*").alias("shared"))
    star = common.written(bounded(star, marks), "star")
    common.release(spark)  # shuffle files of what is written by now
    best = star.groupBy("x", "xn").agg(F.max_by("c", F.shiftleft(F.col("shared"), 40) + F.col("c").bitwiseAND((1 << 40) - 1)).alias("c")).select("c", "x", "xn")
    links = links_of(best, docs, first)
    parts_of = _components(links)
    apart = _apart(star, parts_of)
    links, parts_of, _ = _grown(links, parts_of, apart, docs, first)
    common.discard(star, apart)
    common.release(spark)
    share = 0.0
    for _ in range(NEAREST_ROUNDS):
        member = _open_members(lists, parts_of)
        found, bands = _tile_pairs(member, parts_of, marks, parts, 1, None)
        by = F.shiftleft(F.col("d").cast("long"), 40) + F.col("x").bitwiseAND((1 << 40) - 1)
        found = common.written(found.groupBy("c").agg(F.min_by("x", by).alias("x"), F.min_by("xn", by).alias("xn")), "tiles")
        common.discard(member, bands)
        links, parts_of, share = _grown(links, parts_of, found, docs, first)
        common.discard(found)
        common.release(spark)
        if share is None:
            break
    if share is not None:
        parts_of = _all_open(lists, links, parts_of, marks, parts, docs, first)
    of_item = items.select("a", "r", "id").distinct().join(parts_of.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_item = of_item.withColumn("doc_id", F.when(F.col("r") < 1 << 31, F.col("a"))).withColumn("p", place)
    of_item = common.written(of_item.select("a", "r", "doc_id", "p", "component"), "of-item")
    low = common.written(of_item.groupBy("component").agg(F.min("p").alias("low"), F.min("doc_id").alias("component_id"), F.count("*").alias("k")).where("k > 1").drop("k"), "low")
    common.discard(lists, first, parts_of)
    common.release(spark)
    judged = of_item.join(low, "component", "left").select("a", "r", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("p") == F.col("low"), F.lit(True)).alias("stays"))
    rows = keyed.where("n >= 0").select("a", "r", "n")
    doc_id = F.when(F.col("r") < 1 << 31, F.col("a"))
    return rows.join(judged, ["a", "r"], "left").select("a", "r", "n", F.coalesce("component_id", doc_id).alias("component_id"), F.coalesce("stays", F.lit(True)).alias("stays"))


def _all_open(lists: DataFrame, links: DataFrame, parts_of: DataFrame, marks: DataFrame, parts: int, docs: DataFrame, first: DataFrame) -> DataFrame:
    """Components after tests of all pairs of different components that may still link, in rounds of a bounded number for each seeker."""
    member, turns, take = _open_members(lists, parts_of), None, 1
    while turns is None or not turns.isEmpty():
        take *= MORE
        found, bands = _tile_pairs(member, parts_of, marks, parts, take, turns)
        by = Window.partitionBy("c").orderBy("d", "x")
        found = common.written(found.distinct().withColumn("k", F.row_number().over(by)).where(F.col("k") <= take).drop("k"), "tiles")
        full = found.groupBy("c").agg(F.max(F.struct("d", "x")).alias("m"), F.count("*").alias("k")).where(F.col("k") >= take)
        before, turns = turns, common.written(full.select(F.col("c").alias("id"), F.col("m.d").alias("last_d"), F.col("m.x").alias("last_x")), "turns")
        common.discard(bands, *([] if before is None else [before]))
        links, parts_of, _ = _grown(links, parts_of, found.select("c", "x", "xn"), docs, first)
        common.discard(found)
        common.release(member.sparkSession)
    common.discard(member, turns)
    return parts_of


def _open_members(lists: DataFrame, parts_of: DataFrame) -> DataFrame:
    """Members of the lists that hold several components beside their centre, and whether they seek: those outside the largest one do. Written."""
    placed = lists.where("id <> c").join(parts_of.select(F.col("node").alias("id"), F.col("component").alias("part")), "id", "left")
    placed = placed.select("list", "id", "n", F.coalesce("part", "id").alias("part"), _band(F.col("n")).alias("band"))
    shares = placed.groupBy("list", "part").agg(F.count("*").alias("k"))
    main = shares.groupBy("list").agg(F.max_by("part", "k").alias("main"), F.count("*").alias("parts")).where("parts > 1").select("list", "main")
    return common.written(placed.join(main, "list").select("list", "id", "n", "band", (F.col("part") != F.col("main")).alias("seeks")), "open")


def _tile_pairs(member: DataFrame, parts_of: DataFrame, marks: DataFrame, parts: int, take: int, turns: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Pairs (c, x, xn, d) of the tiles (list, size band, block) of members, and a table that they are read from.

    All that seek do so after no cursor, or those of turns(id, last_d, last_x) after theirs. Who seeks stays as ``member`` says, so that each pair
    keeps its seeker; pairs that are in one component by now are left out.
    """
    firsts = member.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("list")), 1, FIRST_LISTS).alias("firsts"))
    nodes = parts_of.select(F.col("node").alias("id"), F.col("component").alias("part"))
    held = member.join(nodes, "id", "left").withColumn("part", F.coalesce("part", "id"))
    if turns is None:
        held = held.withColumn("turn", F.col("seeks")).withColumn("last_d", F.lit(-1)).withColumn("last_x", F.lit(0).cast("long"))
    else:
        held = held.join(turns, "id", "left").withColumn("turn", F.col("seeks") & F.col("last_d").isNotNull())
        held = held.withColumn("last_d", F.coalesce("last_d", F.lit(-1))).withColumn("last_x", F.coalesce("last_x", F.lit(0).cast("long")))
    # the bands of all sizes that a seeker can link to: one or two
    near = F.explode(F.sequence(_band(F.ceil(F.col("n") * NUM / DEN)), _band(F.floor(F.col("n") * DEN / NUM)))).alias("band")
    seekers = held.where("turn").select("list", "id", "n", "part", "last_d", "last_x", F.col("band").alias("home"), near)
    # a band without seekers around it, or whose only member seeks, has no tile
    sizes = member.groupBy("list", "band").agg(F.count("*").alias("size"), F.min("id").alias("lone"))
    asked = seekers.groupBy("list", "band").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("size") / TILE, F.lit(1.0))))).cast("int").alias("blocks")
    bands = common.written(sizes.join(asked, ["list", "band"]).where("NOT (size = 1 AND lo = hi AND lone = lo)").select("list", "band", blocks), "bands")
    home = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    held = held.join(bands, ["list", "band"]).withColumn("block", home)
    # in its own block a seeker asks where it stands; copies go to the others
    asking = seekers.join(bands, ["list", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asking = asking.where((F.col("band") != F.col("home")) | (F.col("block") != home)).withColumn("seeks", F.lit(True)).withColumn("turn", F.lit(True))
    cols = ["list", "band", "block", "id", "n", "part", "seeks", "turn", "last_d", "last_x"]
    both = held.select(*cols, F.lit(False).alias("asks")).union(asking.select(*cols, F.lit(True).alias("asks")))
    tiles = both.join(marks.select("id", "bits").join(firsts, "id"), "id").repartition(parts, "list", "band", "block").sortWithinPartitions("list", "band", "block", "id")
    return tiles.mapInArrow(common.lean(tile_pairs(take, turns is None and take == 1)), "c long, x long, xn int, d int"), bands


def _band(n: Column) -> Column:
    """A size's band: bands are so wide that the sizes a set can link to lie in one or two."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / (BAND * math.log(DEN / NUM)) + 1e-9).cast("int")


def _grown(links: DataFrame, parts_of: DataFrame, pairs: DataFrame, docs: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame, float | None]:
    """links and their components after tests of more pairs, and the share of these that link; None if there are none."""
    wanted = pairs.count()
    if not wanted:
        return links, parts_of, None
    more = links_of(pairs, docs, first)
    n = more.count()
    if n:
        links = links.union(more)
        before, parts_of = parts_of, _components(links)
        common.discard(before)
    return links, parts_of, n / wanted


def _apart(pairs: DataFrame, parts_of: DataFrame) -> DataFrame:
    """The pairs (c, x, xn) whose ends are not in one component."""
    both = pairs.select("c", "x", "xn").join(parts_of.toDF("c", "cp"), "c", "left").join(parts_of.toDF("x", "xp"), "x", "left")
    return common.written(both.where("cp IS NULL OR xp IS NULL OR cp <> xp").select("c", "x", "xn"), "apart")


def _components(links: DataFrame) -> DataFrame:
    return common.connected_components(links.select(F.col("c").alias("src"), F.col("x").alias("dst")))
