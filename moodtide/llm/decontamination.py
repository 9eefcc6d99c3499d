r"""op10: benchmark decontamination by winnowing.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of A-Z lower-cased texts. For spans of ``window`` words, hashes of
k-grams (k = window / 2) are winnowed: of each window - k + 1 neighbouring hashes the smallest is kept, the last of equal ones, so every
span of ``window`` words that a document shares with an item keeps a fingerprint that both have. An item of fewer
words is one gram of its own length, and has to occur whole.

1. ``fingerprints`` of the items are a table; a filter of fixed size holds them.
2. Documents are winnowed in one pass; those of their distinct fingerprints that the filter lets through go on, with the text.
3. Documents and items are joined on fingerprints; pairs are made distinct. A document's items come in groups of about
   ``group_bytes`` of text.
4. Each hit is extended: all windows of the document that cover a shared fingerprint are looked up among the items' windows of the group
   (and the items' among them), which is linear in both texts, however often words repeat.

Null, empty and wordless texts have no words and no hits. Items without words or item_id are left out; items that repeat count once;
texts of one item_id count together. Rows equal in doc_id and text are judged alike, null doc_ids like others. Without items nothing is
hit. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import common
from moodtide.llm import textkit as tk

WINDOW, GROUP_BYTES, FILTER_BITS, FILTER_PARTS = 10, 8 << 20, 26, 64
_U = np.uint64


def words_of(t: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    start, end = t.spans(tk.ALNUM)
    return t.hashes(start, end), t.owner(start)


def winnowed(words: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each owner's words, and the word at which each begins; fewer words than a window have none."""
    k = window // 2
    g, at = tk.windows(words, owner, k)
    span = window - k + 1
    if len(g) < span:
        return g[:0], at[:0]
    own, n = owner[at], len(g) - span + 1
    low, last = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, span):
        up = g[j : n + j] <= low
        low[up], last[up] = g[j : n + j][up], j
    one = own[:n] == own[span - 1 :]
    kept = np.zeros(len(g), bool)
    kept[(np.arange(n) + last)[one]] = True
    return g[kept], at[kept]


def _slots(prints: np.ndarray) -> np.ndarray:
    """Two cells of the filter for each fingerprint."""
    return np.concatenate([prints >> _U(64 - FILTER_BITS), (prints << _U(13)) >> _U(64 - FILTER_BITS)]).astype(np.int64)


def fingerprints(items: DataFrame, window: int) -> DataFrame:
    """(print, item_id, k) of items(item_id, text): k is 0 for winnowed ones, else the number of words of an item that is shorter."""

    def rows(batches):
        for b in batches:
            ids = b.column("item_id")
            for t in tk.slices(b.column("text"), lower=True):
                words, owner = words_of(t)
                size = np.bincount(owner, minlength=t.n)
                for k in [0, *np.unique(size[(size > 0) & (size < window)]).tolist()]:
                    of = np.flatnonzero(size[owner] >= window if k == 0 else size[owner] == k)
                    f, at = winnowed(words[of], owner[of], window) if k == 0 else tk.windows(words[of], owner[of], k)
                    yield pa.record_batch([pa.array(f.view(np.int64)), ids.take(pa.array(owner[of][at] + t.first)), pa.array(np.full(len(f), k, np.int32))], names=["print", "item_id", "k"])

    return items.mapInArrow(common.lean(rows), "print long, item_id string, k int").distinct()


def print_filter(prints: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Packed bits of fixed size that hold all fingerprints, and the lengths of the shorter items' grams."""

    def rows(batches):
        part, bits, sizes = None, None, 0
        for b in batches:
            for p, f, k in zip(*(b.column(c).to_numpy() for c in ("part", "cell", "k")), strict=True):
                if p != part:
                    if part is not None:
                        yield pa.record_batch([pa.array([int(part)]), pa.array([np.packbits(bits).tobytes()]), pa.array([sizes])], names=["part", "bits", "sizes"])
                    part, bits, sizes = p, np.zeros((1 << FILTER_BITS) // FILTER_PARTS, bool), 0
                bits[f] = True
                sizes |= 1 << int(k)
        if part is not None:
            yield pa.record_batch([pa.array([int(part)]), pa.array([np.packbits(bits).tobytes()]), pa.array([sizes])], names=["part", "bits", "sizes"])

    def cells(batches):
        for b in batches:
            slot = _slots(b.column("print").to_numpy().view(np.uint64))
            size = (1 << FILTER_BITS) // FILTER_PARTS
            yield pa.record_batch([pa.array(slot // size), pa.array(slot % size), pa.array(np.tile(b.column("k").to_numpy(), 2))], names=["part", "cell", "k"])

    dealt = prints.select("print", "k").mapInArrow(common.lean(cells), "part long, cell long, k int").distinct().repartition(FILTER_PARTS, "part").sortWithinPartitions("part")
    out, sizes = np.zeros((1 << FILTER_BITS) // 8, np.uint8), 0
    for r in dealt.mapInArrow(common.lean(rows), "part long, bits binary, sizes long").collect():  # FILTER_PARTS rows of fixed size
        bits = np.frombuffer(r["bits"], np.uint8)
        out[r["part"] * len(bits) : (r["part"] + 1) * len(bits)] = bits
        sizes |= r["sizes"]
    return out, [k for k in range(64) if sizes >> k & 1]


def _marked(docs: DataFrame, held, ks: list[int], window: int) -> DataFrame:
    """docs(a, r, text) as (a, r, n_words, prints, text): distinct fingerprints that the filter has, and the text where there are some."""

    def rows(batches):
        for b in batches:
            for t in tk.slices(b.column("text"), lower=True):
                bits = held.value
                words, owner = words_of(t)
                f, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for k in ks:
                    g, at = winnowed(words, owner, window) if k == 0 else tk.windows(words, owner, k)
                    s = _slots(g)
                    on = ((bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1).astype(bool)
                    on = np.flatnonzero(on[: len(g)] & on[len(g) :])
                    f.append(g[on]), own.append(owner[at[on]])
                f, edges = tk.sorted_sets(np.concatenate(f), np.concatenate(own), t.n)
                some = np.diff(edges) > 0
                text = b.column("text").slice(t.first, t.n)
                text = pa.array([x if y else None for x, y in zip(text.to_pylist(), some.tolist(), strict=True)], pa.string()) if some.any() else pa.nulls(t.n, pa.string())
                prints = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(f.view(np.int64)))
                yield pa.record_batch([b.column("a").slice(t.first, t.n), b.column("r").slice(t.first, t.n), pa.array(np.bincount(owner, minlength=t.n)), prints, text], names=["a", "r", "n_words", "prints", "text"])

    return docs.mapInArrow(common.lean(rows), "a long, r long, n_words long, prints array<long>, text string")


def hits_in(words: np.ndarray, item_words: np.ndarray, item_owner: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words of one document are hit by items, and which of the n items hit it: shared fingerprints, extended by windows around them."""
    hit, found = np.zeros(len(words) + 1, np.int64), np.zeros(n, bool)
    size = np.bincount(item_owner, minlength=n)
    one = np.zeros(len(words), np.int64)
    for k in [0, *np.unique(size[(size > 0) & (size < window)]).tolist()]:
        of = np.flatnonzero(size[item_owner] >= window if k == 0 else size[item_owner] == k)
        iw, io, long = item_words[of], item_owner[of], k or window
        dw, at = tk.windows(words, one, long)
        gw, gat = tk.windows(iw, io, long)
        if not len(dw) or not len(gw):
            continue
        if k == 0:
            f, place = winnowed(words, one, window)
            shared = place[np.isin(f, winnowed(iw, io, window)[0])]
            near = np.zeros(len(words) + 1, np.int64)
            np.add.at(near, np.maximum(shared + window // 2 - window, 0), 1)
            np.add.at(near, shared + 1, -1)
            near = np.cumsum(near)[at] > 0
            dw, at = dw[near], at[near]
        match = np.isin(dw, gw)
        np.add.at(hit, at[match], 1)
        np.add.at(hit, at[match] + long, -1)
        found[io[gat[np.isin(gw, dw)]]] = True
    return np.cumsum(hit)[:-1] > 0, found


def _extended(window: int):
    """From rows (a, r, text, items), an item being (item_id, text): spans (first word, end) and the items that hit."""

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                doc = b.slice(i, 1)
                texts = doc.column("items")[0].values
                words, own = [], []
                for t in tk.slices(texts.field("text"), lower=True):
                    h, o = words_of(t)
                    words.append(h), own.append(o + t.first)
                d = np.concatenate([words_of(t)[0] for t in tk.slices(doc.column("text"), lower=True)])
                hit, found = hits_in(d, np.concatenate(words), np.concatenate(own), len(texts), window)
                if not found.any():
                    continue
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                names = sorted({x for x, y in zip(texts.field("item_id").to_pylist(), found.tolist(), strict=True) if y})
                spans = pa.array([[{"first": int(x), "end": int(y)} for x, y in zip(first, end, strict=True)]], SPANS)
                yield pa.record_batch([doc.column("a"), doc.column("r"), spans, pa.array([names], pa.list_(pa.string()))], names=["a", "r", "spans", "items"])

    return rows


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_SPANS = "spans array<struct<first: long, end: long>>"


def _united(batches):
    """Spans of all groups of a document, joined where they meet, and its items, sorted."""
    for b in batches:
        spans, items = [], []
        for groups, names in zip(b.column("all_spans").to_pylist(), b.column("all_items").to_pylist(), strict=True):
            out: list[dict] = []
            for s in sorted((x for g in groups for x in g), key=lambda x: (x["first"], x["end"])):
                if out and s["first"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(dict(s))
            spans.append(out), items.append(sorted({x for g in names for x in g}))
        yield pa.record_batch([b.column("a"), b.column("r"), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], names=["a", "r", "spans", "items"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """(a, r, n_words) of every row of docs(a, r, text), and (a, r, spans, items) of those that an item hits."""
    spark = docs.sparkSession
    common.ship(spark)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    prints = common.written(fingerprints(items, window), "prints")
    bits, ks = print_filter(prints)
    held = spark.sparkContext.broadcast(bits)  # 2**FILTER_BITS bits
    marked = common.written(_marked(docs, held, ks, window), "marked")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    some = marked.where("text IS NOT NULL").select("a", "r", F.explode("prints").alias("print"))
    pairs = some.join(prints.select("print", "item_id"), "print").select("a", "r", "item_id").distinct()
    group = F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("g")
    of_doc = pairs.join(items, "item_id").groupBy("a", "r", group).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))  # about group_bytes
    texts = marked.where("text IS NOT NULL").select("a", "r", "text").dropDuplicates(["a", "r"])
    found = texts.join(of_doc, ["a", "r"]).select("a", "r", "text", "items").mapInArrow(common.lean(_extended(window)), f"a long, r long, {_SPANS}, items array<string>")
    found = found.groupBy("a", "r").agg(F.collect_list("spans").alias("all_spans"), F.collect_list("items").alias("all_items"))
    found = common.written(found.mapInArrow(common.lean(_united), f"a long, r long, {_SPANS}, items array<string>"), "hits")
    common.discard(prints)
    return marked.select("a", "r", "n_words"), found


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows of docs, all columns, that share no window with an item."""
    a, r = common.fresh(docs, "a"), common.fresh(docs, "r")
    _, found = contaminated(common.keyed(docs.select("doc_id", "text")).select("a", "r", "text"), benchmark, window, group_bytes)
    return common.keyed(docs, a, r).join(found.select(F.col("a").alias(a), F.col("r").alias(r)), [a, r], "left_anti").select(*docs.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, hit spans (first word, end) and the item_ids, sorted as strings, of every document."""
    every, found = contaminated(common.keyed(docs.select("doc_id", "text")).select("a", "r", "text"), benchmark, window, group_bytes)
    out = every.join(found, ["a", "r"], "left")
    doc_id = F.when(F.col("r") < 1 << 31, F.col("a")).alias("doc_id")
    none = F.array().cast("array<struct<first: long, end: long>>"), F.array().cast("array<string>")
    return out.select(doc_id, "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
