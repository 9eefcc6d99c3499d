r"""op12: a bigram language model in Elias-Fano tries, and the scores of whole texts.

Tokens are words ``[^\x20\x09-\x0D]+`` of A-Z lower-cased texts, then one end; the same boundary symbol is the context of the first token, so that each
token has a context and each symbol is a context as often as it is a token. For a context v with C tokens after it, T of them different, and a bigram of count c
the model has (c - D) / C where c > 0, and else (D T / C) p(w), with p(w) = (c(w) + 1) / (N + V + 1) (c: the token's count, N: all, V: different ones), which it takes
alone after a context that training lacks. Discounted mass is not scaled to the tokens left, so probabilities add up to at most 1. Logarithms are quantised to 1 / ``STEPS`` of a decade; a
text's score is a sum of whole numbers, equal in any order and for any number of shards.

1. ``survey``: tokens are counted, and words that are a large part of them found: fewer than ``HEAVY_PARTS`` exist in any corpus.
2. Training: each slice of texts hands on its distinct bigrams and their counts as packed arrays, dealt by context; the successors of a heavy context are dealt to blocks by
   word, each a shard. A shard becomes a trie: its words; its contexts with pointers into their successors and running sums of counts, both monotone; the successors as numbers of the shard's
   words, made monotone over all contexts by the context's rank; quantised counts. All levels are Elias-Fano sequences in one byte string.
3. Scoring: tries and packed bigrams of all texts meet by shard, a heavy shard's tries in copies for ``SALTS`` parts of the texts. A task maps its tries
   into memory (from a file without a name, which ends with the task) and finds a bigram by successor search for (context's rank, word's number). It hands on sums by text, and the words of bigrams
   that training lacks, which are looked up among the contexts in a second round.
4. Sums meet by slice of texts and are added up there, packed as they are.

Only the heavy words with their counts and two totals go to the driver, all of bounded number. The rest grows with the corpus and is dealt by hash. Words are held by 48 bits of their hash, successors by 40
beside their context.

Null texts are empty: one token, the end. A null doc_id is hashed as an empty string and so belongs to training. Each row is a text of its own, repeated or not. Other columns are ignored. An
empty table gives an empty result; without training rows every token is unknown and has probability 1.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import common
from moodtide.llm import elias_fano as ef
from moodtide.llm import textkit as tk

U = np.uint64
STEPS, DISCOUNT = 1024, 0.75
HEAVY_PARTS, BLOCKS, SALTS = 256, 16, 8
SHARD_TOKENS, SHARDS_PER_TASK, SLICE, ROWS, BATCH, MERGE_ROWS = 1_000_000, 4, 4 << 20, 50_000, 1 << 18, 1 << 21
#: Words as contexts are held by 48 bits of their hash, as successors by the first 40 of these.
CONTEXT_BYTES, WORD_BYTES = 6, 5
_CONTEXT, _CUT = U(64 - 8 * CONTEXT_BYTES), U(8 * (CONTEXT_BYTES - WORD_BYTES))
BOUNDARY = U(0x6A09E667F3BC)
FOLD, HELD_OUT = 7, 2


def quantised(x: np.ndarray) -> np.ndarray:
    """log10 in whole STEPS."""
    return np.floor(np.log10(x) * STEPS + 0.5).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLD == HELD_OUT


def _slices(b: pa.RecordBatch) -> Iterator[tuple[tk.Texts, pa.RecordBatch]]:
    for at in range(0, b.num_rows, ROWS):
        part = b.slice(at, ROWS)
        for t in tk.slices(part.column("text"), lower=True, limit=SLICE):
            yield t, part.slice(t.first, t.n)


def _tokens(t: tk.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, token and text of each token of a slice, by 48-bit hashes."""
    start, end = t.spans(tk.BLANK_SEPARATED)
    h, own = t.hashes(start, end) >> _CONTEXT, t.owner(start)
    count = np.bincount(own, minlength=t.n) + 1
    after = np.full(len(h) + t.n, BOUNDARY, U)
    before = after.copy()
    at = np.arange(len(h)) + own
    after[at], before[at + 1] = h, h
    return before, after, np.repeat(np.arange(t.n), count)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of values, plane by plane: those of sorted values shrink when Spark compresses them."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def _small(values: np.ndarray) -> bytes:
    """Small whole numbers, compressed, behind their number."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.array([len(values)], "<u8").tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _from_small(raw: bytes) -> np.ndarray:
    n = _number(raw)
    out = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(out.T).reshape(-1).view("<u4").astype(np.int64)


def _number(raw: bytes) -> int:
    return int(np.frombuffer(raw[:8], "<u8")[0])


class Layout:
    """Which shard a bigram goes to, and which task a shard."""

    def __init__(self, shards: int, tasks: int, heavy: np.ndarray):
        self.shards, self.tasks, self.heavy = shards, tasks, np.sort(heavy)
        self.blocks = max(BLOCKS, shards * 8 // HEAVY_PARTS)

    def rank(self, v: np.ndarray) -> np.ndarray:
        """Place of each context among the heavy ones, or -1; by the bits that successors have."""
        keys = self.heavy >> _CUT
        at = np.searchsorted(keys, v >> _CUT)
        return np.where((at < len(keys)) & (np.append(keys, 0)[at] == v >> _CUT), at, -1)

    def shard(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """w: tokens by the bits that successors have."""
        rank = self.rank(v)
        plain = (tk.mix(v >> _CUT) % U(self.shards)).astype(np.int64)
        return np.where(rank < 0, plain, self.shards + rank * self.blocks + (tk.mix(w) % U(self.blocks)).astype(np.int64))

    def task(self, shard: np.ndarray, salt: int = 0) -> np.ndarray:
        return np.where(shard < self.shards, shard % self.tasks, (31 * shard + 7 * (salt % SALTS)) % self.tasks)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, end: int) -> np.ndarray:
    return np.diff(np.append(starts, end))


def _packed(layout: Layout, v, w, own, salt: int = 0, summed: bool = False) -> Iterator[tuple]:
    """Distinct (context, token, text) by task: task, contexts, bigrams of each, tokens, texts of each bigram, texts, counts; without texts if summed."""
    w = w >> _CUT
    order = np.lexsort((w, v) if summed else (own, w, v))
    v, w, own = v[order], w[order], own[order]
    first = _starts(v, w) if summed else _starts(v, w, own)
    count = _lengths(first, len(v))
    v, w, own = v[first], w[first], own[first]
    task = layout.task(layout.shard(v, w), salt)
    order = np.argsort(task.astype(np.uint16) if layout.tasks <= 1 << 16 else task, kind="stable")
    v, w, own, count, task = v[order], w[order], own[order], count[order], task[order]
    yield from _rows(task, v, w, own, count, summed)


def _rows(task, v, w, own, count, summed: bool) -> Iterator[tuple]:
    """Packed rows of entries sorted by (task, context, token)."""
    edges = np.append(_starts(task), len(task))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        pairs = _starts(v[a:b], w[a:b])
        pv, pw = v[a:b][pairs], w[a:b][pairs]
        heads = _starts(pv)
        texts = (b"", b"") if summed else (_small(_lengths(pairs, b - a)), _small(own[a:b]))
        yield int(task[a]), _planes(pv[heads], CONTEXT_BYTES), _small(_lengths(heads, len(pv))), _planes(pw, WORD_BYTES), *texts, _small(count[a:b])


PACKED = ("task", "v", "runs", "w", "reps", "own", "count")


def _unpacked(v: bytes, runs: bytes, w: bytes, reps: bytes, own: bytes, count: bytes) -> tuple[np.ndarray, ...]:
    v, w = np.repeat(_from_planes(v, CONTEXT_BYTES), _from_small(runs)), _from_planes(w, WORD_BYTES)
    if not reps:
        return v, w, np.zeros(0, np.int64), _from_small(count)
    reps = _from_small(reps)
    return np.repeat(v, reps), np.repeat(w, reps), _from_small(own), _from_small(count)


# --- survey and training ---------------------------------------------------------------------------


def survey(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of tokens, and the words that are more than 1 / HEAVY_PARTS of them."""

    def count(batches):
        for b in batches:
            for t, _ in _slices(b):
                v, _, _ = _tokens(t)
                words, n = np.unique(v, return_counts=True)
                often = n * 2 * HEAVY_PARTS > len(v)
                yield pa.record_batch({"v": pa.array(np.append(words[often], 0).view(np.int64)), "n": pa.array(np.append(n[often], 0)), "all": pa.array(np.append(np.zeros(often.sum(), np.int64), len(v)))})

    found = texts.select("text").mapInArrow(common.lean(count), "v long, n long, all long").groupBy("v").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    found = common.written(found, "survey")
    total = found.agg(F.sum("all")).first()[0] or 0
    heavy = [r["v"] for r in found.where(F.col("n") * HEAVY_PARTS > total).select("v").collect()]  # fewer than HEAVY_PARTS
    common.discard(found)
    return total, np.array(heavy, np.int64).view(U)


def build_trie(v: np.ndarray, w: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes, int, int, int]:
    """Contexts and successors of distinct (v, w), sorted: two parts of the trie, numbers of contexts, tokens and bigrams."""
    heads = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    sums = np.append(0, np.cumsum(count))
    begin = np.append(heads, len(v))
    contexts = ef.encode(v[heads]) + ef.encode(sums[begin]) + ef.encode(begin)
    words, number = np.unique(w, return_inverse=True)
    bits = max(1, int(len(words) - 1).bit_length())
    rank = np.repeat(np.arange(len(heads)), np.diff(begin))
    codes = quantised(count - DISCOUNT) - quantised(np.array([1 - DISCOUNT]))
    levels = np.array([bits], "<u8").tobytes() + ef.encode(words) + ef.encode((rank.astype(U) << U(bits)) | number.astype(U)) + codes.astype("<u2").tobytes()
    return contexts, levels, len(heads), int(sums[-1]), len(v)


def _summed(held, waiting) -> tuple[np.ndarray, ...]:
    """Distinct (context, token) in order, and their counts."""
    v, w, count = (np.concatenate(x) for x in zip(*([held] if held else []), *waiting, strict=True))
    order = np.lexsort((w, v))
    v, w, count = v[order], w[order], count[order]
    first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
    return v[first], w[first], np.add.reduceat(count, first)


def train(texts: DataFrame, layout: Layout) -> DataFrame:
    """(shard, contexts, levels, n_contexts, n_tokens, n_bigrams), a trie a row, of texts(text)."""

    def bigrams(batches):
        for b in batches:
            for t, _ in _slices(b):
                yield _batch([dict(zip(PACKED, r, strict=True)) for r in _packed(layout, *_tokens(t), summed=True)], [f for f in _QUERY if f[0] in PACKED])

    def tries(batches):
        held, waiting, size = None, [], 0
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in PACKED[1:]), strict=True):
                v, w, _, count = _unpacked(*r)
                waiting.append((v, w, count))
                size += len(v)
                if size > MERGE_ROWS + (len(held[0]) if held else 0):  # memory follows the distinct bigrams, not the slices that have them
                    held, waiting, size = _summed(held, waiting), [], 0
        if held is None and not waiting:
            return
        v, w, count = _summed(held, waiting)
        shard = layout.shard(v, w)
        for s in np.unique(shard).tolist():
            on = shard == s
            trie = build_trie(v[on], w[on], count[on])
            yield pa.record_batch([pa.array([x]) for x in (s, *trie)], names=["shard", "contexts", "levels", "n_contexts", "n_tokens", "n_bigrams"])

    packed = texts.select("text").mapInArrow(common.lean(bigrams), "task int, v binary, runs binary, w binary, reps binary, own binary, count binary")
    return packed.repartitionById(layout.tasks, F.col("task")).mapInArrow(common.lean(tries), "shard long, contexts binary, levels binary, n_contexts long, n_tokens long, n_bigrams long")


# --- scoring ---------------------------------------------------------------------------------------


class Trie:
    """The levels of a shard, read in place; levels may be absent where only contexts are asked for."""

    def __init__(self, contexts: bytes, levels: bytes | None):
        self.file = tempfile.TemporaryFile()  # without a name: it goes with the task
        self.file.write(contexts + (levels or b""))
        self.file.flush()
        held = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        self.keys = ef.Sequence(held)
        self.sums = ef.Sequence(held, self.keys.end)
        self.begin = ef.Sequence(held, self.sums.end)
        if levels:
            self.bits = U(np.frombuffer(held, "<u8", 1, self.begin.end)[0])
            self.words = ef.Sequence(held, self.begin.end + 8)
            self.after = ef.Sequence(held, self.words.end)
            self.codes = np.frombuffer(held, "<u2", self.after.n, self.after.end)

    def context(self, v: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank, count and number of successors of each context, 0 and 0 for one that isn't there; not whole: by the bits that successors have."""
        if whole:
            at, known = self.keys.find(v)
        else:
            at = self.keys.successor((v >> _CUT) << _CUT)
            known = at < self.keys.n
            known[known] = self.keys.get(at[known]) >> _CUT == v[known] >> _CUT
        at = np.where(known, at, 0)
        c = (self.sums.get(at + 1) - self.sums.get(at)).astype(np.int64) * known
        return at, c, (self.begin.get(at + 1) - self.begin.get(at)).astype(np.int64) * known

    def code(self, rank: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Quantised counts of bigrams (context's rank, token); -1 for those that aren't there."""
        number, known = self.words.find(w)
        out = np.full(len(w), -1, np.int64)
        on = np.flatnonzero(known)
        at, found = self.after.find((rank[on].astype(U) << self.bits) | number[on].astype(U))
        out[on[found]] = self.codes[at[found]]
        return out


_QUERY = [("task", pa.int32()), ("kind", pa.int32()), ("slice", pa.int64()), *((k, pa.binary()) for k in PACKED[1:])]
_SUMS = [("texts", pa.list_(pa.int32())), ("units", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("doc_id", pa.list_(pa.int64())), ("learnt", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64()))]
_QUERY_SQL = "task int, kind int, slice long, " + ", ".join(f"{k} binary" for k in PACKED[1:])
_ALL_SQL = f"{_QUERY_SQL}, texts array<int>, units array<long>, known array<long>, base array<double>, doc_id array<long>, learnt array<boolean>, n array<long>"


def _batch(rows: list[dict], fields: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(k) for r in rows], kind) for k, kind in fields], names=[k for k, _ in fields])


def _partial(where: int, own, units, known, base) -> dict:
    docs, back = np.unique(own, return_inverse=True)
    total = lambda x: np.bincount(back, x, len(docs))
    return {"slice": where, "texts": docs.astype(np.int32), "units": total(units).astype(np.int64), "known": total(known).astype(np.int64), "base": total(base)}


def _scorer(layout: Layout, totals: dict, first: bool):
    """Sums by text of packed bigrams (first), or of the words of bigrams that training lacks."""
    norm = float(totals["tokens"] + totals["words"] + 1)
    unit_norm = int(quantised(np.array([norm]))[0])
    unit_drop, unit_one = int(quantised(np.array([DISCOUNT]))[0]), int(quantised(np.array([1 - DISCOUNT]))[0])

    def contexts(tries, v, shard):
        """Rank, count and successors of distinct contexts, each in the shard of its bigram."""
        rank, c, t = (np.zeros(len(v), np.int64) for _ in range(3))
        for s in np.unique(shard).tolist():
            if s in tries:
                on = np.flatnonzero(shard == s)
                rank[on], c[on], t[on] = tries[s].context(v[on], first)
        hot = layout.rank(v)
        on = hot >= 0
        c[on], t[on] = totals["heavy_c"][hot[on]], totals["heavy_t"][hot[on]]
        return rank, c, t

    def bigrams(tries, rows):
        sizes = [_number(r["count"]) for r in rows]
        v, w, own, count = (np.concatenate(x) for x in zip(*(_unpacked(*(r[k] for k in PACKED[1:])) for r in rows), strict=True))
        shard = layout.shard(v, w)
        heads = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (shard[1:] != shard[:-1])))
        back = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(v))))
        rank, c, t = contexts(tries, v[heads], shard[heads])
        code = np.full(len(v), -1, np.int64)
        for s in np.unique(shard).tolist():
            if s in tries:
                on = np.flatnonzero(shard == s)
                code[on] = tries[s].code(rank[back[on]], w[on])
        missed = (code < 0) | (c[back] == 0)
        total = np.where(c > 0, quantised(np.maximum(c, 1)), 0)
        lost = np.where(c > 0, unit_drop + quantised(np.maximum(t, 1)) - total, 0)
        units = np.where(missed, lost[back], code + unit_one - total[back]) * count
        known, base = (c > 0)[back] * count, np.log10((c + 1) / norm)[back] * count
        out, edges = [], np.append(0, np.cumsum(sizes))
        for r, a, b in zip(rows, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            x = slice(a, b)
            out.append(_partial(r["slice"], own[x], units[x], known[x], base[x]))
        # what is missed in all these rows goes on together, a row for each task that is asked: texts by their slice's place in w
        lacks = np.flatnonzero(missed)
        if len(lacks):
            of, held = np.unique([r["slice"] for r in rows], return_inverse=True)
            text = np.repeat(held, sizes)[lacks] * ROWS + own[lacks]
            out += [dict(zip(PACKED, p, strict=True), kind=1, slice=-1, w=of.astype("<i8").tobytes()) for p in _missed(layout, w[lacks] << _CUT, text, count[lacks])]
        return out

    def words(tries, rows):
        v, own, count, where = [], [], [], []
        for r in rows:
            reps, text = _from_small(r["reps"]), _from_small(r["own"])
            v.append(np.repeat(np.repeat(_from_planes(r["v"], CONTEXT_BYTES), _from_small(r["runs"])), reps))
            own.append(text % ROWS)
            where.append(np.frombuffer(r["w"], "<i8")[text // ROWS])
            count.append(_from_small(r["count"]))
        v, own, count, where = map(np.concatenate, (v, own, count, where))
        heads = _starts(v)
        back = np.repeat(np.arange(len(heads)), _lengths(heads, len(v)))
        _, c, _ = contexts(tries, v[heads], layout.shard(v[heads], v[heads] >> _CUT))
        units = (quantised(c + 1.0) - unit_norm)[back] * count
        order = np.argsort(where, kind="stable")
        own, units, where = own[order], units[order], where[order]
        edges = np.append(_starts(where), len(where))
        zero = np.zeros(len(v))
        return [_partial(int(where[a]), own[a:b], units[a:b], zero[a:b], zero[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    work = bigrams if first else words

    def run(batches):
        tries, rows, held = {}, [], 0
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    tries[r["slice"]] = Trie(r["v"], r["w"])
                    continue
                if r["kind"] == 2:  # the texts of a slice
                    null = np.frombuffer(r["runs"], np.uint8)
                    ids = [None if x else i for i, x in zip(np.frombuffer(r["v"], "<i8").tolist(), null.tolist(), strict=True)]
                    n = np.frombuffer(r["count"], "<u8").tolist()
                    yield _batch([{"slice": r["slice"], "texts": list(range(len(n))), "doc_id": ids, "learnt": (np.frombuffer(r["w"], np.uint8) > 0).tolist(), "n": n}], _QUERY + _SUMS)
                    continue
                rows.append(r)
                held += _number(r["count"])
                if held >= BATCH:
                    yield _batch(work(tries, rows), _QUERY + _SUMS)
                    rows, held = [], 0
        if rows:
            yield _batch(work(tries, rows), _QUERY + _SUMS)

    return run


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and where each list's begin; null is an empty list."""
    return column.flatten(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))


def _merged(batches):
    """A row for each text, from rows sorted by slice: its sums, which come packed from each task, and what the slice's own row says of it."""
    last, about, n = None, None, 0
    sums = {"units": np.zeros(ROWS, np.int64), "known": np.zeros(ROWS, np.int64), "base": np.zeros(ROWS)}

    def texts():
        out = pa.record_batch([*about, *(pa.array(v[:n].copy()) for v in sums.values())], names=["doc_id", "learnt", "n", *sums])
        for v in sums.values():
            v[:] = 0
        return out

    for b in batches:
        where = b.column("slice").to_numpy()
        cols = {c: _lists(b.column(c)) for c in ("texts", *sums, "doc_id", "learnt", "n")}
        at, offs = cols["texts"][0].to_numpy(), cols["texts"][1]
        values = {c: cols[c][0].to_numpy() for c in sums}
        for i in range(b.num_rows):
            if where[i] != last:
                if last is not None:
                    yield texts()
                last, about = where[i], None
            x, y = cols["n"][1][i : i + 2]
            if y > x:
                about, n = [cols[c][0].slice(x, y - x) for c in ("doc_id", "learnt", "n")], int(y - x)
                continue
            own = at[offs[i] : offs[i + 1]]
            for c, total in sums.items():
                a = cols[c][1][i]
                total[own] += values[c][a : a + len(own)]  # a text stands once in a row
    if last is not None:
        yield texts()


def _missed(layout: Layout, w: np.ndarray, own: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
    """Words of bigrams that training lacks, by the task of the word as a context; their counts by text are added up."""
    order = np.lexsort((own, w))
    w, own, count = w[order], own[order], count[order]
    first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (own[1:] != own[:-1])))
    w, own, count = w[first], own[first], np.add.reduceat(count, first)
    task = layout.task(layout.shard(w, w >> _CUT))
    order = np.argsort(task, kind="stable")
    yield from _rows(task[order], w[order], w[order] >> _CUT, own[order], count[order], False)


def _meet(tries: DataFrame, queries: DataFrame, layout: Layout, levels: bool) -> DataFrame:
    """Tries before queries in each task; heavy shards in a copy for each salt (first round), as contexts they aren't asked for."""
    salts = F.when(F.col("shard") < layout.shards, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    chosen = tries if levels else tries.where(F.col("shard") < layout.shards)
    task = F.when(F.col("shard") < layout.shards, F.col("shard") % layout.tasks).otherwise((31 * F.col("shard") + 7 * F.col("salt")) % layout.tasks)
    first = chosen.withColumn("salt", F.explode(salts)).select(
        task.cast("int").alias("task"), F.lit(0).alias("kind"), F.col("shard").alias("slice"), F.col("contexts").alias("v"), F.lit(b"").alias("runs"), (F.col("levels") if levels else F.lit(b"")).alias("w"), *(F.lit(b"").alias(k) for k in PACKED[4:])
    )
    return first.union(queries).repartitionById(layout.tasks, F.col("task")).sortWithinPartitions("kind", "slice")


def scores(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs(doc_id, text); rows where ``training`` is true are learnt from."""
    spark = docs.sparkSession
    common.ship(spark)
    training = ~held_out(F.col("doc_id")) if training is None else training
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("learnt"))
    n_tokens, heavy = survey(rows)
    tasks = max(common.reduce_partitions(spark), n_tokens // (SHARD_TOKENS * SHARDS_PER_TASK))
    layout = Layout(SHARDS_PER_TASK * tasks, tasks, heavy)
    tries = common.written(train(rows.where("learnt"), layout), "tries")
    common.release(spark)  # shuffle files of training
    plain = tries.where(F.col("shard") < layout.shards).agg(F.coalesce(F.sum("n_contexts"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    c, t = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
    hot = tries.where(F.col("shard") >= layout.shards).groupBy(F.expr(f"(shard - {layout.shards}) div {layout.blocks}").alias("rank"))
    for r in hot.agg(F.sum("n_tokens").alias("c"), F.sum("n_bigrams").alias("t")).collect():  # fewer than HEAVY_PARTS
        c[r["rank"]], t[r["rank"]] = r["c"], r["t"]
    totals = {"tokens": plain[1] + int(c.sum()), "words": plain[0] + int((c > 0).sum()), "heavy_c": c, "heavy_t": t}

    def queries(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for t, part in _slices(b):
                v, w, own = _tokens(t)
                out = [dict(zip(PACKED, p, strict=True), kind=1, slice=number) for p in _packed(layout, v, w, own, number + (number >> 32))]
                ids, learnt = part.column("doc_id"), part.column("learnt").to_numpy(zero_copy_only=False)
                about = {"v": ids.fill_null(0).to_numpy(), "runs": ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), "w": learnt.astype(np.uint8), "count": np.bincount(own, minlength=t.n).astype("<u8")}
                out.append({"task": number % layout.tasks, "kind": 2, "slice": number, **{k: x.tobytes() for k, x in about.items()}})
                yield _batch(out, _QUERY)
                number += 1

    asked = rows.mapInArrow(common.lean(queries), _QUERY_SQL)
    found = common.written(_meet(tries, asked, layout, levels=True).mapInArrow(common.lean(_scorer(layout, totals, first=True)), _ALL_SQL), "found")
    common.release(spark)
    misses = found.where("kind = 1").select("task", "kind", "slice", *PACKED[1:])
    rest = _meet(tries, misses, layout, levels=False).mapInArrow(common.lean(_scorer(layout, totals, first=False)), _ALL_SQL)
    arrays = ("texts", "units", "known", "base", "doc_id", "learnt", "n")
    both = found.where("texts IS NOT NULL").select("slice", *arrays).union(rest.select("slice", *arrays)).repartition(layout.tasks, "slice").sortWithinPartitions("slice")
    sums = both.mapInArrow(common.lean(_merged), "doc_id long, learnt boolean, n long, units long, known long, base double")
    return sums.select(
        "doc_id", (~F.col("learnt")).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(totals["tokens"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("units") / STEPS).alias("score")
    )


def op12_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"))


def _q(x: str) -> str:
    return f"floor(log10({x}) * {STEPS} + 0.5)::BIGINT"


ORACLE = rf"""
WITH RECURSIVE byte(i, x, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM byte WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS tab FROM byte WHERE k = 8),
texts AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws,
                 xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: coalesce(ascii(ch), 0)::BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % {FOLD} = {HELD_OUT} AS held_out
          FROM documents, crc),
token AS (SELECT k, held_out, unnest(list_concat([''], ws)) AS v, unnest(list_concat(ws, [''])) AS w FROM texts),
bigram AS (SELECT v, w, count(*) AS c FROM token WHERE NOT held_out GROUP BY 1, 2),
context AS (SELECT v, sum(c) AS c, count(*) AS t FROM bigram GROUP BY 1),
total AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, (coalesce(sum(c), 0) + count(*) + 1)::DOUBLE AS norm FROM context),
scored AS (SELECT k, count(*) AS n_tokens, count(one.c) AS n_known, sum(log10((coalesce(one.c, 0) + 1) / norm)) AS base,
                  sum(CASE WHEN bigram.c IS NOT NULL THEN {_q(f"bigram.c - {DISCOUNT}::DOUBLE")} - {_q("ctx.c")}
                           ELSE {_q("coalesce(one.c, 0) + 1")} - {_q("norm")} + CASE WHEN ctx.c IS NULL THEN 0 ELSE {_q(f"{DISCOUNT}::DOUBLE")} + {_q("ctx.t")} - {_q("ctx.c")} END END) AS units
           FROM token LEFT JOIN bigram USING (v, w) LEFT JOIN context ctx ON ctx.v = token.v LEFT JOIN context one ON one.v = token.w, total GROUP BY 1)
SELECT doc_id, held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, n AS train_tokens, base AS base_score, units / {STEPS}::DOUBLE AS score FROM texts JOIN scored USING (k), total
"""
