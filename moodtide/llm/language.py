"""op2: language proportions of a document by expectation-maximisation over n-gram likelihoods.

A model holds a probability of each hashed byte 4-gram (letters lower-cased, all other ASCII as one
blank) in each language. N-grams with like likelihood profiles share a class, so that a document is a
short count vector over classes, whose likelihoods are exact sums over the members. EM estimates the mixture
weights on a language set; the set grows greedily from the best single language while the penalised log-likelihood
rises. The largest weight names the language; the score is that weight times the posterior of the first language
alone, so that a text of few or undecided n-grams has a low one (1 / languages where it has none).

The model is fitted on at most ``max_docs`` documents of each language, those whose doc_id and text hash lowest; rows equal in
doc_id, text and language are one document there. The driver holds 2 MB for each language. ``held_out`` is null where doc_id is null. A
text that is null, or has no letter, is ``und`` with score 0, as is every text if no labelled document can be
learnt from. Repeated rows, ties (the language that sorts first) and other columns change nothing; null doc_ids are judged, but teach nothing; empty
tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodtide.llm import common
from moodtide.llm import textkit as tk

MAX_DOCS, BITS, PART, LEVELS, EM_STEPS, SALTS = 2000, 18, 1 << 14, 6, 12, 64
#: A document whose first language has a smaller share is rejected by ``identified``.
MIN_SCORE = 0.5
#: Log-likelihood that one more language must add: a part for each n-gram, as neighbours overlap, and a fixed part.
PENALTY_SHARE, PENALTY = 0.01, 6.0
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123], _FOLD[128:] = np.arange(97, 123), np.arange(128, 256)
_FOLD[65:91] = np.arange(97, 123)


def grams(t: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 4-grams of folded bytes, and the text of each."""
    d = _FOLD[t.data].astype(np.uint32)
    if len(d) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    g = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
    own = np.repeat(np.arange(t.n), np.diff(t.offs))
    one = own[:-3] == own[3:]
    return ((g[one] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)), own[:-3][one]


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> dict | None:
    """The model of docs(doc_id, text, lang); texts stay on the executors, counts of fixed size reach the driver."""
    common.ship(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # the lowest of each salted part of a language, then of these: no language meets in one task
    usable = usable.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    ids = usable.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))  # repeated rows are one
    for keys in (["lang", "salt"], ["lang"]):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("r") <= max_docs)
    some = usable.join(F.broadcast(ids.select("lang", "h")), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])  # max_docs a language at most

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for t in tk.slices(b.column("text")):
                g, own = grams(t)
                names = np.array([str(x) for x in langs[t.first : t.first + t.n]])
                for name in np.unique(names):
                    total[name] = total.get(name, 0) + np.bincount(g[(names == name)[own]], minlength=1 << BITS)
        for name, n in total.items():
            cells = n.astype(np.int64).reshape(-1, PART)
            of = np.flatnonzero(cells.any(1))
            yield pa.record_batch([pa.array([name] * len(of)), pa.array(of.astype(np.int32)), pa.array([cells[i].tobytes() for i in of])], names=["lang", "part", "n"])

    # counts go in parts of cells, each summed in a task of its own: as many numbers a language, whatever the input, reach the driver
    parts = some.select("lang", "text").mapInArrow(common.lean(count), "lang string, part int, n binary")
    summed = parts.repartition(common.reduce_partitions(docs.sparkSession), "lang", "part").sortWithinPartitions("lang", "part").mapInArrow(common.lean(_added), "lang string, part int, n binary").toArrow()
    counts: dict[str, np.ndarray] = {}
    for lang, part, n in zip(*(summed[k].to_pylist() for k in ("lang", "part", "n")), strict=True):
        counts.setdefault(lang, np.zeros(1 << BITS))[part * PART : (part + 1) * PART] = np.frombuffer(n, np.int64)
    return model_of(counts) if counts else None


def _added(batches):
    """Sums of the counts of rows sorted by language and part."""
    key, total = None, None
    for b in batches:
        for lang, part, n in zip(*(b.column(k).to_pylist() for k in ("lang", "part", "n")), strict=True):
            if key != (lang, part):
                if key:
                    yield pa.record_batch([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()])], names=["lang", "part", "n"])
                key, total = (lang, part), np.zeros(PART, np.int64)
            total += np.frombuffer(n, np.int64)
    if key:
        yield pa.record_batch([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()])], names=["lang", "part", "n"])


def model_of(counts: dict[str, np.ndarray]) -> dict:
    langs = sorted(counts)
    p = np.stack([counts[k] + 0.05 for k in langs], 1)
    p /= p.sum(0)
    level = np.clip(np.round(np.log2(p / p.max(1, keepdims=True))), -LEVELS, 0).astype(np.int64)
    _, code = np.unique(level, axis=0, return_inverse=True)
    code = code.reshape(-1)
    classes = np.zeros((code.max() + 1, len(langs)))
    np.add.at(classes, code, p)
    return {"langs": langs, "code": code.astype(np.uint16 if code.max() < 65536 else np.uint32), "p": classes}


def mixture(h: np.ndarray, p: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Mixture weights and log-likelihoods of count vectors h (documents by classes) under p (classes by languages)."""
    w = np.full((len(h), p.shape[1]), 1 / p.shape[1])
    n = np.maximum(h.sum(1, keepdims=True), 1)
    for _ in range(steps):
        w = w * ((h / np.maximum(w @ p.T, 1e-300)) @ p) / n
    return w, (h * np.log(w @ p.T + 1e-300)).sum(1)


def infer(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weights of all languages, 0 outside each document's chosen set."""
    n, k = len(h), p.shape[1]
    ll = h @ np.log(p)
    best = ll.argmax(1)
    chosen = np.zeros((n, k), bool)
    chosen[np.arange(n), best] = True
    weight, score = chosen.astype(float), ll[np.arange(n), best]
    penalty = PENALTY + PENALTY_SHARE * h.sum(1)
    live = np.arange(n)
    while len(live):
        gain, to, ws = np.full(len(live), -np.inf), np.zeros(len(live), int), np.zeros((len(live), k))
        # documents with the same set so far are tried together
        sets, back = np.unique(chosen[live], axis=0, return_inverse=True)
        for s, have in enumerate(sets):
            of = np.flatnonzero(back.reshape(-1) == s)
            for add in np.flatnonzero(~have):
                cols = np.flatnonzero(have | (np.arange(k) == add))
                w, got = mixture(h[live[of]], p[:, cols])
                more = got - score[live[of]] > gain[of]
                gain[of[more]], to[of[more]] = (got - score[live[of]])[more], add
                ws[of[more]] = 0
                ws[np.ix_(of[more], cols)] = w[more]
        up = gain > penalty[live]
        live, to, ws, gain = live[up], to[up], ws[up], gain[up]
        chosen[live, to] = True
        weight[live] = ws
        score[live] += gain
        live = live[chosen[live].sum(1) < k]
    return weight


def judge(t: tk.Texts, model: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a slice."""
    ascii_letter = np.append(0, np.cumsum((t.data | 32) - np.uint8(97) < 26))
    other = np.append(0, np.cumsum(t.data >= 128))
    has = np.diff(ascii_letter[t.offs]) > 0
    for i in np.flatnonzero(~has & (np.diff(other[t.offs]) > 0)):
        has[i] = any(c.isalpha() for c in t.data[t.offs[i] : t.offs[i + 1]].tobytes().decode("utf-8", "replace"))
    score, lang = np.zeros(t.n), np.full(t.n, "und", object)
    if model is None:
        return lang, score
    g, own = grams(t)
    c = len(model["p"])
    begin, code, langs = tk.bounds(own, t.n), model["code"][g].astype(np.int64), np.array(model["langs"], object)
    step = max(1, (1 << 20) // c)
    for a in range(0, t.n, step):
        z = min(t.n, a + step)
        cut = slice(begin[a], begin[z])
        h = np.bincount((own[cut] - a) * c + code[cut], minlength=(z - a) * c).reshape(z - a, c).astype(float)
        w = infer(h, model["p"])
        ll = h @ np.log(model["p"])
        alone = np.exp(ll - ll.max(1, keepdims=True))
        lang[a:z], score[a:z] = langs[w.argmax(1)], np.clip(w.max(1) / alone.sum(1), 0, 1)
    lang[~has], score[~has] = "und", 0
    return lang, score


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) of docs(doc_id, text)."""
    common.ship(docs.sparkSession)

    def rows(batches):
        for b in batches:
            for t in tk.slices(b.column("text")):
                lang, score = judge(t, model)
                yield pa.record_batch([b.column("doc_id").slice(t.first, t.n), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(rows), "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: dict | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, all columns, that have a language with at least that share."""

    def rows(batches):
        for b in batches:
            for t in tk.slices(b.column("text")):
                lang, score = judge(t, model)
                yield b.slice(t.first, t.n).filter(pa.array((lang != "und") & (score >= min_score)))

    return docs.mapInArrow(common.lean(rows), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~common.held_out(F.col("doc_id")))


def op2_mixture_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs, fit(training_rows(docs)))
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
