r"""op7: removal of lines that resemble an earlier line, by an exact set-similarity join on their words.

A line's tokens are its distinct words ``[^\x20\x09-\x0D]+``, A-Z lower-cased. Two lines match at a Jaccard similarity of at least
NUM / DEN of these sets. A line goes if any earlier line of the input matches it, whether or not that one goes as well. Lines are
ordered by doc_id (null last), a hash of the text, and line number.

1. ``line_keys``: one pass names each line by 128 bits of its words in order and counts hashed words in a sketch of fixed size;
   equal lines are found by these names. The sketch gives each word a rarity level.
2. ``postings``: words are ordered by (level, hash), which is one order for all lines however good the levels are. Two matching
   sets share a word of the first n - ceil(T n) + 1 of the larger and of the first n - ceil(2 T n / (1 + T)) + 1 of the smaller. These
   prefixes go, as packed arrays with position, size and a parity signature of the set, to buckets of words.
3. ``shortlist``: in each list of a word, the length filter gives ranges of sizes, the positional filter bounds the overlap by what
   follows the shared word in both, and differing parities bound it by the least symmetric difference. Each line
   takes one earlier line that the filters leave; the lists of all lines with such partners are kept.
4. Pairs are verified on their sets. Lines whose partner failed take their next 16, then 256, ... best ones from the kept lists
   until one matches or none is left: the join is exact, and no round hands on all pairs of a group.

Null, empty and blank texts have no tokens and stay as they are, as do lines without a word. Rows equal in doc_id and text are one
document and are cut alike; other rows of one doc_id are documents of their own. A text of which every line with a word goes is
``emptied``. Texts keep their other lines, joined by line breaks. Other columns stay; those named ``n_lines``, ``n_removed`` or
``emptied`` give way to the results. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodtide.llm import common
from moodtide.llm import textkit as tk

NUM, DEN = 80, 100
SKETCH_BITS, BLOCK, SEEN_BITS, LONG_LIST, PAIRS, LEADERS, MEMBERS = 22, 1_000_000, 17, 1024, 400_000, 128, 512
#: Words of all lines for each bucket of postings, at most, as an average.
BUCKET_WORDS = 16_000_000
#: Candidates of a line in the first round of verification, and the factor by which later rounds take more.
MORE = 16
_U = np.uint64
#: name, type of the packed columns of a posting. The sign of n is negative beyond the smaller set's own prefix.
PACKED = (("tag", np.uint32), ("n", np.int32), ("pos", np.uint16), ("a", np.int64), ("sub", np.uint64), ("s0", np.uint64), ("s1", np.uint64))
#: members: how many of its list are kept.
MEMBER = "list long, members int, a long, sub long, n int, pos int, s0 long, s1 long"


# -- keys of documents and lines -------------------------------------------------------------------------------------


def _sub(r: np.ndarray, number: np.ndarray) -> np.ndarray:
    return (r.astype(np.uint64) << _U(32)) | number.astype(np.uint64)


def line_no(sub: Column) -> Column:
    return sub.bitwiseAND(0xFFFFFFFF)


def row_of(sub: Column) -> Column:
    return F.shiftrightunsigned(sub, 32)


def place(a: str, sub: str) -> Column:
    """A line's place in the order of lines."""
    return F.struct((F.col(sub) < 0).alias("f"), F.col(a).alias("a"), F.col(sub).alias("s"))


def _earlier(a: np.ndarray, sub: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether line j is before line i."""
    f = sub >> _U(63)
    return np.where(f[i] != f[j], f[j] < f[i], np.where(a[i] != a[j], a[j] < a[i], sub[j] < sub[i]))


# -- words of lines --------------------------------------------------------------------------------------------------


def words_of(t: tk.Texts) -> tuple[np.ndarray, ...]:
    """Word hashes, where each line with words begins among them, and those lines' texts and numbers."""
    start, end = t.spans(tk.BLANK_SEPARATED)
    line_start, _, own = t.lines()
    begin = np.append(np.searchsorted(start, line_start), len(start))
    number = np.arange(len(own)) - np.searchsorted(own, own)
    full = np.flatnonzero(np.diff(begin))
    return t.word_hashes(start, end), np.append(begin[full], len(start)), own[full], number[full]


def line_keys(docs: DataFrame) -> DataFrame:
    """(a, sub, h1, h2) of each line with words, and the counts (cell, count) of the sketch in rows whose h1 is null."""

    def rows(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            a, r = b.column("a").to_numpy(), b.column("r").to_numpy()
            for t in tk.slices(b.column("text"), lower=True):
                h, begin, own, number = words_of(t)
                if not len(own):
                    continue
                np.add.at(sketch, (h >> _U(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))  # one type for both: far faster
                h1, h2 = tk.run_hash(h, begin[:-1], begin[1:]), tk.sums(tk.mix(h), begin)
                yield pa.record_batch([pa.array(a[own + t.first]), pa.array(_sub(r[own + t.first], number).view(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["a", "sub", "h1", "h2"])
        hot = np.flatnonzero(sketch)
        if len(hot):
            total = int(sketch.sum(dtype=np.int64))
            hot = hot[sketch[hot] >= 4 + 2 * total // (1 << SKETCH_BITS)]  # rare words need no level
            none = pa.nulls(len(hot) + 1, pa.int64())
            cells, counts = np.append(hot, -1), np.append(sketch[hot].astype(np.int64), total)
            yield pa.record_batch([pa.array(cells.astype(np.int64)), pa.array(counts), none, none], names=["a", "sub", "h1", "h2"])

    return docs.mapInArrow(common.lean(rows), "a long, sub long, h1 long, h2 long")


def levels(keys: DataFrame) -> tuple[np.ndarray, int]:
    """Rarity level of each sketch cell, and the number of words; at most 2**SKETCH_BITS + 1 rows reach the driver, whatever the input."""
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    rows = keys.where("h1 IS NULL").groupBy("a").agg(F.sum("sub").alias("c")).toArrow()
    cell, count = rows["a"].to_numpy(), rows["c"].to_numpy()
    out[cell[cell >= 0]] = np.minimum(2 * np.log2(np.maximum(count[cell >= 0], 1)), 63).astype(np.uint8)
    return out, int(count[cell < 0].sum())


def copies(keys: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, sub) of each line that equals an earlier one word by word, and the tables that this is read from."""
    lines = keys.where("h1 IS NOT NULL")
    # counts need no sort; places, whose minima do, are those of repeated lines only
    again = common.written(lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2"), "line-again")
    same = common.written(common.probably_among(lines, again, ["h1", "h2"]).join(again, ["h1", "h2"]), "line-same")
    common.discard(again)
    first = common.written(same.groupBy("h1", "h2").agg(F.min(place("a", "sub")).alias("p")), "line-first")  # read again, so that a very common line's rows may be split over tasks
    return same.join(first, ["h1", "h2"]).where(place("a", "sub") != F.col("p")).select("a", "sub"), [same, first]


# -- prefixes --------------------------------------------------------------------------------------------------------


def prefix_lengths(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many first tokens a set needs against all sets, and against those no smaller."""
    return n - (NUM * n + DEN - 1) // DEN + 1, n - (2 * NUM * n + NUM + DEN - 1) // (NUM + DEN) + 1


def least_overlap(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    return (NUM * (n1 + n2) + NUM + DEN - 1) // (NUM + DEN)


def signatures(v: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parities of each non-empty set: how many tokens fall into each of 128 cells, modulo 2."""
    cell = (v >> _U(13)) & _U(127)
    bit = _U(1) << (cell & _U(63))
    return tuple(np.bitwise_xor.reduceat(np.where(part, bit, _U(0)), edges[:-1]) for part in (cell < _U(64), cell >= _U(64)))


class Seen:
    """The earliest line of recent names, direct-mapped: of equal lines of a task few are posted."""

    def __init__(self):
        self.name, self.a, self.sub = (np.zeros(1 << SEEN_BITS, t) for t in (np.uint64, np.int64, np.uint64))

    def first(self, name: np.ndarray, a: np.ndarray, sub: np.ndarray) -> np.ndarray:
        """The lines that no equal line of this slice, or remembered one, is before."""
        order = np.lexsort((sub, a, sub >> _U(63), name))
        keep = order[np.append(True, name[order][1:] != name[order][:-1])[: len(order)]]
        slot = (name[keep] >> _U(64 - SEEN_BITS)).astype(np.int64)
        known = np.flatnonzero(self.name[slot] == name[keep])
        both_a, both_s = np.concatenate([a[keep[known]], self.a[slot[known]]]), np.concatenate([sub[keep[known]], self.sub[slot[known]]])
        at = np.arange(len(known))
        ok = np.ones(len(keep), bool)
        ok[known] = _earlier(both_a, both_s, at + len(known), at)  # posted again only if it is before the remembered one
        keep, slot = keep[ok], slot[ok]
        self.name[slot], self.a[slot], self.sub[slot] = name[keep], a[keep], sub[keep]
        return np.sort(keep)


def postings(docs: DataFrame, level, buckets: int) -> DataFrame:
    """(bucket, and the packed columns) of the prefixes of the lines of each task."""

    def rows(batches):
        known, seen, held, size = level.value, Seen(), [], 0

        def block():
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            bucket = ((cols[0] >> _U(32)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            some, edge = np.unique(bucket[order], return_index=True)
            cut = list(zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True))
            packed = [c[order].astype(t) for c, (_, t) in zip(cols, PACKED, strict=True)]
            return pa.record_batch([pa.array(some), *(pa.array([memoryview(p[x:y]).tobytes() for x, y in cut], pa.binary()) for p in packed)], names=["bucket", *(k for k, _ in PACKED)])

        for b in batches:
            doc, row = b.column("a").to_numpy(), b.column("r").to_numpy()
            for t in tk.slices(b.column("text"), lower=True):
                h, begin, own, number = words_of(t)
                if not len(own):
                    continue
                a, sub = doc[own + t.first], _sub(row[own + t.first], number)
                one = seen.first(tk.run_hash(h, begin[:-1], begin[1:]), a, sub)
                if not len(one):
                    continue
                count = np.diff(begin)[one]
                h = h[tk.ragged(begin[one], count)]
                # one sort puts each set in rarity order; its last bits are the first bits of the hash
                token = (known[(h >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << _U(58)) | (h >> _U(6))
                token, edges = tk.sorted_sets(token, np.repeat(np.arange(len(one)), count), len(one))
                n = np.diff(edges)
                prefix, smaller = prefix_lengths(n)
                pos = tk.ragged(np.zeros(len(n), np.int64), prefix)
                of = np.repeat(np.arange(len(n)), prefix)
                s0, s1 = signatures(token, edges)
                sign = np.where(pos < smaller[of], 1, -1)
                held.append((tk.mix(token[edges[:-1][of] + pos]), n[of] * sign, np.minimum(pos, 65535), a[one][of], sub[one][of], s0[of], s1[of]))
                size += len(of)
                if size >= BLOCK:
                    yield block()
                    held, size = [], 0
        if size:
            yield block()

    return docs.mapInArrow(common.lean(rows), "bucket long, " + ", ".join(f"{k} binary" for k, _ in PACKED))


# -- filters ---------------------------------------------------------------------------------------------------------


class Members:
    """Columns of postings; n is positive, own tells whether the posting is in the smaller set's prefix."""

    def __init__(self, n, pos, a, sub, s0, s1):
        self.own, self.n, self.pos, self.a, self.sub, self.s0, self.s1 = n > 0, np.abs(n).astype(np.int64), pos.astype(np.int64), a, sub, s0, s1

    def score(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Millionths of the similarity that the filters leave possible for each pair of postings of one word; 0 where none is."""
        n1, n2 = self.n[i], self.n[j]
        least = least_overlap(n1, n2)
        ok = (DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)) & np.where(n1 == n2, self.own[i] & self.own[j], np.where(n1 < n2, self.own[i], self.own[j]))
        # the positional filter: a pair's first shared word is met at these places, and what follows bounds the overlap
        most = np.minimum(n1 - self.pos[i], n2 - self.pos[j])
        ok &= (most >= least) & ((self.a[i] != self.a[j]) | (self.sub[i] != self.sub[j]))  # equal rows are one document
        out = np.zeros(len(ok), np.int64)
        k = np.flatnonzero(ok)
        i, j, most, least, n1, n2 = i[k], j[k], most[k], least[k], n1[k], n2[k]
        apart = np.bitwise_count(self.s0[i] ^ self.s0[j]).astype(np.int64) + np.bitwise_count(self.s1[i] ^ self.s1[j])
        most = np.minimum(np.minimum(n1, n2), (n1 + n2 - apart) // 2)
        out[k] = np.where(most >= least, 1_000_000 * most // (n1 + n2 - most), 0)
        return out


def _best(x: np.ndarray, y: np.ndarray, score: np.ndarray, m: Members, best: np.ndarray, value: np.ndarray) -> None:
    """Updates the best earlier partner of each x, ties to the earlier one."""
    order = np.lexsort((m.sub[y], m.a[y], m.sub[y] >> _U(63), -score, x))
    first = order[np.append(True, x[order][1:] != x[order][:-1])[: len(order)]]
    x, y, score = x[first], y[first], score[first]
    up = score > value[x]
    best[x[up]], value[x[up]] = y[up], score[up]


def shortlist(batches):
    """From rows sorted by bucket: members (list, members, a, sub, n, pos, s0, s1) of the lists of lines with partners, and one partner of each line."""
    bucket, held = None, None

    def lists(cols):
        tag = cols["tag"]
        order = np.lexsort((np.abs(cols["n"]), tag))
        tag = tag[order]
        twice = np.zeros(len(tag) + 1, bool)
        twice[1:-1] = tag[1:] == tag[:-1]
        keep = twice[1:] | twice[:-1]
        order, tag = order[keep], tag[keep]
        if not len(order):
            return
        m = Members(*(cols[k][order] for k, _ in PACKED[1:]))
        edges = np.append(np.flatnonzero(np.append(True, tag[1:] != tag[:-1])), len(tag))
        g = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        best, value, part = np.full(len(g), -1), np.zeros(len(g), np.int64), np.zeros(len(g), bool)
        top = DEN * int(m.n.max()) // NUM + 2
        key = g * top + m.n
        end = np.searchsorted(key, g * top + DEN * m.n // NUM, "right")
        count = np.where(m.own & (np.diff(edges)[g] <= LONG_LIST), end - np.arange(len(g)) - 1, 0)
        upto, at = np.cumsum(count), 0
        while at < len(g):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            i = np.repeat(np.arange(at, to), count[at:to])
            j = tk.ragged(np.arange(at, to) + 1, count[at:to])
            s = m.score(i, j)
            k = np.flatnonzero(s)
            i, j, s = i[k], j[k], s[k]
            part[i] = part[j] = True
            back = _earlier(m.a, m.sub, i, j)
            x, y = np.where(back, i, j), np.where(back, j, i)
            _best(x, y, s, m, best, value)
            at = to
        for k in np.flatnonzero(np.diff(edges) > LONG_LIST).tolist():
            of = np.arange(edges[k], edges[k + 1])
            of = of[np.lexsort((m.sub[of], m.a[of], m.sub[of] >> _U(63)))]  # by place
            _long_list(m, of, best, value)
            part[of] = bool((best[of] >= 0).any())
        k = np.flatnonzero(part)
        if len(k):
            some = best[k]
            none = some < 0
            name = tk.mix((tag[k].astype(np.uint64) << _U(32)) ^ tk.mix(np.full(len(k), bucket, np.uint64)))
            n = np.where(m.own[k], m.n[k], -m.n[k])
            members = np.bincount(g[k])[g[k]]
            mine = [name.view(np.int64), members.astype(np.int32), m.a[k], m.sub[k].view(np.int64), n.astype(np.int32), m.pos[k].astype(np.int32), m.s0[k].view(np.int64), m.s1[k].view(np.int64)]
            yield pa.record_batch([*map(pa.array, mine), pa.array(m.a[some], mask=none), pa.array(m.sub[some].view(np.int64), mask=none), pa.array(value[k], mask=none)], names=["list", "members", "a", "sub", "n", "pos", "s0", "s1", "ya", "ysub", "score"])

    def unpacked():
        return {k: np.frombuffer(b"".join(held[k]), t) for k, t in PACKED}

    for batch in batches:
        cols = {k: batch.column(k).to_pylist() for k, _ in PACKED}
        for r, b in enumerate(batch.column("bucket").to_pylist()):
            if b != bucket:
                if held is not None:
                    yield from lists(unpacked())
                bucket, held = b, {k: [] for k in cols}
            for k in held:
                held[k].append(cols[k][r])
    if held is not None:
        yield from lists(unpacked())


def _long_list(m: Members, of: np.ndarray, best: np.ndarray, value: np.ndarray) -> None:
    """A partner for each line of a list in order of places: those that have one among the first lines look no further."""
    open_, at, width = np.arange(1, len(of)), 0, LEADERS
    while at < len(of) and len(open_):
        leaders = np.arange(at, min(len(of), at + width))
        for a in range(0, len(open_), step := max(1, PAIRS // len(leaders))):
            x, y = np.repeat(open_[a : a + step], len(leaders)), np.tile(leaders, len(open_[a : a + step]))
            ok = x > y
            x, y = of[x[ok]], of[y[ok]]
            s = m.score(x, y)
            k = np.flatnonzero(s)
            _best(x[k], y[k], s[k], m, best, value)
        at, width = at + width, min(2 * width, 4096)
        open_ = open_[(best[of[open_]] < 0) & (open_ > at)]


def _changes(t: pa.Table | pa.RecordBatch, before: pa.RecordBatch | None = None) -> np.ndarray:
    """Whether each row is of another (list, block) than the row before it; before: the rows in front of the first."""
    out = np.zeros(t.num_rows, bool)
    for k in ("list", "block"):
        v = t.column(k).to_numpy()
        out[1:] |= v[1:] != v[:-1]
        out[0] |= before is None or before.column(k)[-1].as_py() != v[0]
    return out


def next_partners(take: int):
    """From rows sorted by (list, block): the next earlier partners, at most ``take`` for each seeking line, in order of score and place."""

    def tiles(t: pa.Table):
        seek, group = t.column("seek").to_numpy(), np.cumsum(_changes(t))
        cols = {k: t.column(k).to_numpy() for k in ("n", "pos", "a", "sub", "s0", "s1", "cs", "ca", "csub")}
        m = Members(cols["n"], cols["pos"], cols["a"], *(cols[k].view(np.uint64) for k in ("sub", "s0", "s1")))
        who, those = np.flatnonzero(seek), np.flatnonzero(~seek)
        begin = np.searchsorted(group[those], group[who])
        count = np.searchsorted(group[those], group[who], "right") - begin
        upto, at = np.cumsum(count), 0
        while at < len(who):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            x, y = np.repeat(who[at:to], count[at:to]), those[tk.ragged(begin[at:to], count[at:to])]
            at = to
            ok = _earlier(m.a, m.sub, x, y)
            x, y = x[ok], y[ok]
            s = m.score(x, y)
            cursor, csub = cols["cs"][x], cols["csub"].view(np.uint64)[x]
            f, cf = m.sub[y] >> _U(63), csub >> _U(63)
            after = np.where(f != cf, f > cf, np.where(m.a[y] != cols["ca"][x], m.a[y] > cols["ca"][x], m.sub[y] > csub))
            k = np.flatnonzero((s > 0) & ((s < cursor) | (s == cursor) & after))
            x, y, s = x[k], y[k], s[k]
            order = np.lexsort((m.sub[y], m.a[y], m.sub[y] >> _U(63), -s, x))
            x, y, s = x[order], y[order], s[order]
            start = np.searchsorted(x, x)
            k = np.arange(len(x)) - start < take
            x, y, s = x[k], y[k], s[k]
            yield pa.record_batch([pa.array(v) for v in (m.a[x], m.sub[x].view(np.int64), m.a[y], m.sub[y].view(np.int64), s)], names=["a", "sub", "ya", "ysub", "score"])

    def rows(batches):
        held = []  # the last tile so far
        for b in batches:
            if not b.num_rows:
                continue
            new = np.flatnonzero(_changes(b, held[-1] if held else None))
            if len(new):  # all tiles before the last one of the batch are whole
                whole = [*held, b.slice(0, int(new[-1]))]
                if any(x.num_rows for x in whole):
                    yield from tiles(pa.Table.from_batches(whole))
                held, b = [], b.slice(int(new[-1]))
            held.append(b)
        if held:
            yield from tiles(pa.Table.from_batches(held))

    return rows


# -- verification ----------------------------------------------------------------------------------------------------


def line_sets(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(a, sub, tokens) of the lines (a, sub) of docs(a, r, text): sorted 64-bit hashes of the distinct words."""
    of_doc = items.groupBy("a", row_of(F.col("sub")).alias("r")).agg(F.collect_set(line_no(F.col("sub"))).alias("wanted"))  # a document's own lines

    def cut(batches):
        for b in batches:
            doc, row = b.column("a").to_numpy(), b.column("r").to_numpy()
            wanted = b.column("wanted")
            for t in tk.slices(b.column("text"), lower=True):
                # only the wanted lines are read as words
                start, end, own = t.lines()
                number = np.arange(len(own)) - np.searchsorted(own, own)
                w = wanted.slice(t.first, t.n)
                key = np.repeat(np.arange(t.n), np.diff(w.offsets.to_numpy())) * (1 << 32) + w.flatten().to_numpy()
                one = np.flatnonzero(np.isin(own * (1 << 32) + number, key))
                if not len(one):
                    continue
                size = (end - start)[one]
                some = tk.Texts(t.data[tk.ragged(start[one], size)], np.append(0, np.cumsum(size)), 0)
                first, last = some.spans(tk.BLANK_SEPARATED)
                v, edges = tk.sorted_sets(some.word_hashes(first, last), some.owner(first), some.n)
                tokens = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer((8 * edges).astype(np.int32)), pa.py_buffer(v)])
                yield pa.record_batch([pa.array(doc[own[one] + t.first]), pa.array(_sub(row[own[one] + t.first], number[one]).view(np.int64)), tokens], names=["a", "sub", "tokens"])

    def once(batches):
        last = None
        for b in batches:
            if b.num_rows:
                a, sub = b.column("a").to_numpy(), b.column("sub").to_numpy()
                new = np.append(last != (a[0], sub[0]), (a[1:] != a[:-1]) | (sub[1:] != sub[:-1]))
                last = a[-1], sub[-1]
                yield b.filter(pa.array(new))

    schema = "a long, sub long, tokens binary"
    found = docs.join(of_doc, ["a", "r"]).select("a", "r", "text", "wanted").mapInArrow(common.lean(cut), schema)
    # equal rows are one document
    return found.repartition(common.reduce_partitions(docs.sparkSession), "a", "sub").sortWithinPartitions("a", "sub").mapInArrow(common.lean(once), schema)


def _matching(batches):
    """(a, sub) of rows whose two sets match."""
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            raw = [part.column(k).to_pylist() for k in ("x", "y")]
            size = [np.array([len(v) // 8 for v in r], np.int64) for r in raw]
            v = np.concatenate([np.frombuffer(b"".join(r), np.uint64) for r in raw])
            pair = np.concatenate([np.repeat(np.arange(len(n)), n) for n in size])
            v, edges = tk.sorted_sets(v, pair, part.num_rows)
            union = np.diff(edges)
            overlap = size[0] + size[1] - union
            yield part.select(["a", "sub"]).filter(pa.array(DEN * overlap >= NUM * union))


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, sub) of the pairs (a, sub, ya, ysub) whose sets match."""
    pairs = pairs.select("a", "sub", "ya", "ysub")
    x = common.probably_among(sets, pairs, ["a", "sub"]).withColumnRenamed("tokens", "x")
    y = common.probably_among(sets, pairs.select(F.col("ya").alias("a"), F.col("ysub").alias("sub")), ["a", "sub"]).toDF("ya", "ysub", "y")
    both = pairs.join(x, ["a", "sub"]).join(y, ["ya", "ysub"])
    return common.written(both.select("a", "sub", "x", "y").mapInArrow(common.lean(_matching), "a long, sub long").distinct(), "matched")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(a, sub) of each line of docs(a, r, text) that equals or matches an earlier one."""
    spark = docs.sparkSession
    common.ship(spark)
    parts = common.reduce_partitions(spark)
    keys = common.written(line_keys(docs), "line-keys")
    table, n_words = levels(keys)
    level = spark.sparkContext.broadcast(table)  # 2**SKETCH_BITS bytes
    buckets = max(4 * parts, n_words // BUCKET_WORDS)
    dealt = postings(docs, level, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = common.written(dealt.mapInArrow(common.lean(shortlist), MEMBER + ", ya long, ysub long, score long"), "line-lists")
    common.release(spark)  # shuffle files of the postings
    equal, again = copies(keys)
    gone = [common.written(equal, "line-copies")]
    common.discard(keys, *again)

    # one of the best partners, by a number, of which maxima need no sort; both columns come from one row
    by = F.shiftleft("score", 40) + F.xxhash64("ya", "ysub").bitwiseAND((1 << 40) - 1)
    pairs = found.where("ya IS NOT NULL").groupBy("a", "sub").agg(F.max_by("ya", by).alias("ya"), F.max_by("ysub", by).alias("ysub"))
    # an equal earlier line already removes these
    pairs = common.written(pairs.join(gone[0], ["a", "sub"], "left_anti"), "line-pairs")
    sets = common.written(line_sets(docs, found.select("a", "sub").distinct()), "line-sets")  # the texts are read once more
    common.release(spark)  # and shuffled with the lines wanted
    gone.append(verified(sets, pairs))
    none = [F.lit((1 << 62)).alias("cs"), F.lit(0).cast("long").alias("ca"), F.lit(0).cast("long").alias("csub")]
    open_ = common.written(pairs.join(gone[1], ["a", "sub"], "left_anti").select("a", "sub", *none), "line-open")
    common.discard(pairs)
    common.release(spark)
    take = 1
    while not open_.isEmpty():
        take *= MORE
        # lines that are still open in a later round were open in this one: their lists are all that it needs
        before, found = found, common.written(_lists_of(found, open_), "line-lists")
        common.discard(before)
        more = common.written(_next(found, open_, take, parts), "line-pairs")
        linked = verified(sets, more)
        gone.append(linked)
        last = F.max(F.struct((-F.col("score")).alias("k"), place("ya", "ysub").alias("p"))).alias("m")
        full = more.groupBy("a", "sub").agg(last, F.count("*").alias("c")).where(F.col("c") >= take)
        rest = full.join(linked, ["a", "sub"], "left_anti").select("a", "sub", (-F.col("m.k")).alias("cs"), F.col("m.p.a").alias("ca"), F.col("m.p.s").alias("csub"))
        before, open_ = open_, common.written(rest, "line-open")
        common.discard(more, before)
    common.discard(found, open_, sets)
    out = gone[0]
    for g in gone[1:]:
        out = out.union(g)
    return out


def _lists_of(found: DataFrame, open_: DataFrame) -> DataFrame:
    """The members of found in the lists of the open lines."""
    members = found.select(*[c.split()[0] for c in MEMBER.split(", ")])
    seekers = common.probably_among(members.select("list", "a", "sub"), open_, ["a", "sub"])
    lists = seekers.join(open_.select("a", "sub"), ["a", "sub"], "left_semi").select("list").distinct()
    return members.join(lists, "list", "left_semi")


def _next(found: DataFrame, open_: DataFrame, take: int, parts: int) -> DataFrame:
    """The next candidates (a, sub, ya, ysub, score) of the open lines (a, sub, cs, ca, csub), at most ``take`` of each; found: the members of their lists."""
    members = found.withColumn("blocks", F.ceil(F.col("members") / MEMBERS).cast("int"))
    held = members.withColumn("block", F.pmod(F.xxhash64("a", "sub"), F.col("blocks")).cast("int"))
    asking = members.join(open_, ["a", "sub"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["list", "block", "n", "pos", "a", "sub", "s0", "s1"]
    zero = [F.lit(0).cast("long").alias(k) for k in ("cs", "ca", "csub")]
    tiles = held.select(*cols, *zero, F.lit(False).alias("seek")).union(asking.select(*cols, "cs", "ca", "csub", F.lit(True).alias("seek")))
    tiles = tiles.repartition(parts, "list", "block").sortWithinPartitions("list", "block")
    pairs = tiles.mapInArrow(common.lean(next_partners(take)), "a long, sub long, ya long, ysub long, score long").distinct()
    by = Window.partitionBy("a", "sub").orderBy(F.col("score").desc(), place("ya", "ysub"))
    return pairs.withColumn("k", F.row_number().over(by)).where(F.col("k") <= take).drop("k")


# -- the operator ----------------------------------------------------------------------------------------------------


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with texts cut, and n_lines (with a word), n_removed and emptied."""
    docs = docs.drop("n_lines", "n_removed", "emptied")
    names = docs.columns
    a, r, out = (common.fresh(docs, k) for k in ("a", "r", "gone"))
    gone = repeated_lines(common.keyed(docs.select("doc_id", "text")).where("text IS NOT NULL").select("a", "r", "text"))
    gone = gone.groupBy(F.col("a").alias(a), row_of(F.col("sub")).alias(r)).agg(F.collect_set(line_no(F.col("sub"))).alias(out))  # a document's own lines

    def cut(batches):
        for b in batches:
            text, lines = b.column("text"), []
            for t in tk.slices(text):
                upto = np.append(0, np.cumsum(tk.BLANK_SEPARATED[t.data], dtype=np.int64))
                start, end, own = t.lines()
                lines.append(np.bincount(own[upto[end] > upto[start]], minlength=t.n))
            lines = np.concatenate(lines) if lines else np.zeros(0, np.int64)
            removed = np.zeros(len(lines), np.int64)
            held = b.column(out)
            if held.null_count < len(held):
                new = text.to_pylist()
                for i, drop in enumerate(held.to_pylist()):
                    if drop is not None:
                        removed[i], drop = len(drop), set(drop)
                        new[i] = "\n".join([p for k, p in enumerate(new[i].split("\n")) if k not in drop])
                text = pa.array(new, pa.string())
            cols = {c: b.column(c) for c in names} | {"text": text, "n_lines": pa.array(lines.astype(np.int64)), "n_removed": pa.array(removed), "emptied": pa.array((lines > 0) & (lines == removed))}
            yield pa.record_batch(list(cols.values()), names=list(cols))

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", n_lines long, n_removed long, emptied boolean"
    return common.keyed(docs, a, r).join(gone, [a, r], "left").select(*names, out).mapInArrow(common.lean(cut), schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "emptied", "text")


#: The same in SQL: words in order of their number of lines and prefixes, as a plain join would test all pairs that share 'the'.
ORACLE = rf"""
WITH lines AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, i, line, list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS ws FROM lines),
s AS (SELECT list_sort(ws) AS ws, min((doc_id, i)) AS p, row_number() OVER (ORDER BY min((doc_id, i))) AS k FROM w WHERE len(ws) > 0 GROUP BY list_sort(ws)),
t AS (SELECT k, len(ws) AS n, unnest(ws) AS word FROM s),
f AS (SELECT word, count(*) AS c FROM t GROUP BY 1 HAVING count(*) > 0),
o AS (SELECT t.k, t.n, t.word, row_number() OVER (PARTITION BY t.k ORDER BY f.c, t.word) AS r FROM t JOIN f USING (word)),
p AS (SELECT * FROM o WHERE r <= n - ({NUM} * n + {DEN - 1}) // {DEN} + 1),
c AS (SELECT DISTINCT a.k AS x, b.k AS y FROM p a JOIN p b ON a.word = b.word AND a.k > b.k AND {DEN} * least(a.n, b.n) >= {NUM} * greatest(a.n, b.n)),
m AS (SELECT DISTINCT x FROM c JOIN s a ON a.k = c.x JOIN s b ON b.k = c.y
      WHERE {DEN} * len(list_intersect(a.ws, b.ws)) >= {NUM} * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))),
g AS (SELECT w.doc_id, w.i, w.line, len(w.ws) > 0 AS filled, len(w.ws) > 0 AND ((w.doc_id, w.i) <> s.p OR m.x IS NOT NULL) AS gone
      FROM w LEFT JOIN s ON list_sort(w.ws) = s.ws LEFT JOIN m ON m.x = s.k)
SELECT d.doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (filled) > 0 AND count(*) FILTER (filled) = count(*) FILTER (gone) AS emptied,
       CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') END AS text
FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id, d.text
"""
