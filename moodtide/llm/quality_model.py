"""op4: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one, and that towards a multiple of
the identity; Cholesky factors are computed once and shipped. The score is the logistic of the difference of
the two Mahalanobis log-densities and log priors.

The model is fitted on at most ``max_rows`` labelled documents, those whose doc_id, and of these whose doc_id and text, hash lowest; the sample's
statistics, not its texts, reach the driver. Null and empty texts have statistics like any other (all 0). Where a class has no
labelled row, its mean and covariance are the pooled ones; without any label every score is 0.5. Rows of
``labels`` whose quality is null, and ids that only one table has, teach nothing; rows equal in doc_id, text and quality
are one there. ``held_out`` is null where doc_id is null. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import common
from moodtide.llm import textkit as tk

MAX_ROWS, SHRINK_TO_POOLED, SHRINK_TO_SPHERE, THRESHOLD = 20_000, 0.2, 0.05, 0.3


def _class(test) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[i for i in range(128) if test(chr(i))]] = True
    return out


_CLASSES = {
    "upper": _class(str.isupper), "digit": _class(str.isdigit), "symbol": _class(lambda c: c in "#*$%&|<>@^~_=+\\{}[]"), "bar": _class(lambda c: c == "|"),
    "bang": _class(lambda c: c in "!?"), "stop": _class(lambda c: c in ".,;:"), "line": _class(lambda c: c == "\n"), "blank": _class(str.isspace),
}
FEATURES = ("log_words", "word_length", "log_line_words", *_CLASSES, "distinct_words", "repeated_windows", "repeated_lines", "end_marks", "next_same", "entropy")


def statistics(t: tk.Texts) -> np.ndarray:
    """One row of transformed statistics for each text; shares go through a square root, which spreads small ones."""
    start, end = t.spans(tk.BLANK_SEPARATED)
    h, own = t.hashes(start, end), t.owner(start)
    at = tk.bounds(own, t.n)
    words = np.diff(at).astype(float)
    size = np.maximum(np.diff(t.offs), 1)
    some = np.maximum(words, 1)

    def total(mask: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask))[begin])

    shares = {k: total(m[t.data], t.offs) / size for k, m in _CLASSES.items()}
    _, distinct = tk.sorted_sets(h, own, t.n)
    w, first = tk.windows(h, own, 5)
    windows = tk.bounds(own[first], t.n)
    _, distinct_w = tk.sorted_sets(w, own[first], t.n)
    ls, le, line_own = t.lines()
    full = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le, line_own = ls[full], le[full], line_own[full]
    _, distinct_l = tk.sorted_sets(t.hashes(ls, le), line_own, t.n)
    lines = np.maximum(np.bincount(line_own, minlength=t.n), 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    mark = np.zeros(256, bool)
    mark[33:48] = mark[58:65] = mark[91:97] = mark[123:127] = True
    marks = total(mark[t.data[end - 1]], at) / some if len(end) else np.zeros(t.n)
    byte = np.bincount(np.repeat(np.arange(t.n), np.diff(t.offs)) * 256 + t.data, minlength=t.n * 256).reshape(t.n, 256) / size[:, None]
    entropy = -(byte * np.log2(byte + 1e-12)).sum(1)
    cols = [np.log1p(words), np.log1p(total(end - start, at) / some), np.log1p(words / lines)]
    cols += [np.sqrt(v) for v in shares.values()]
    cols += [np.sqrt(np.diff(distinct) / some), np.sqrt(1 - np.diff(distinct_w) / np.maximum(np.diff(windows), 1)) * (np.diff(windows) > 0), np.sqrt(1 - np.minimum(np.diff(distinct_l) / lines, 1)) * (words > 0), np.sqrt(marks), np.sqrt(total(same, at) / some), entropy]
    return np.stack(cols, 1)


def _rows(batches):
    for b in batches:
        for t in tk.slices(b.column("text"), limit=tk.SLICE_BYTES):
            x = statistics(t)
            yield pa.record_batch([b.column("h").slice(t.first, t.n), b.column("quality").slice(t.first, t.n), pa.array(list(x), pa.list_(pa.float64()))], names=["h", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict | None:
    common.ship(docs.sparkSession)
    usable = labels.where(F.col("quality").isNotNull() & ~common.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int"))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.xxhash64("doc_id", "text", "quality").alias("h"), "quality", "text")
    # equal rows are one, and many texts of one doc_id don't add up beyond max_rows
    rows = sample.mapInArrow(common.lean(_rows), "h long, quality int, x array<double>").dropDuplicates(["h"]).orderBy("h").limit(max_rows).toArrow()
    if not rows.num_rows:
        return None
    return model_of(np.array(rows["x"].combine_chunks().flatten()).reshape(rows.num_rows, -1), rows["quality"].to_numpy() == 1)


def model_of(x: np.ndarray, good: np.ndarray) -> dict:
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    pooled = np.zeros((z.shape[1],) * 2)
    for c in (False, True):
        if (good == c).any():
            d = z[good == c] - z[good == c].mean(0)
            pooled += d.T @ d
    pooled /= len(z)
    out = {"mean": mean, "scale": scale, "classes": []}
    for c in (False, True):
        own = z[good == c]
        m, s = (own.mean(0), np.cov(own.T, bias=True)) if len(own) > 1 else (own[0] if len(own) else z.mean(0), pooled)
        s = (1 - SHRINK_TO_POOLED) * s + SHRINK_TO_POOLED * pooled
        s = (1 - SHRINK_TO_SPHERE) * s + SHRINK_TO_SPHERE * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        factor = np.linalg.cholesky(s)
        out["classes"].append({"mean": m, "whiten": np.linalg.inv(factor), "constant": np.log((len(own) + 1) / (len(z) + 2)) - np.log(np.diag(factor)).sum()})
    return out


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    z = (x - model["mean"]) / model["scale"]
    bad, good = (c["constant"] - 0.5 * (((z - c["mean"]) @ c["whiten"].T) ** 2).sum(1) for c in model["classes"])
    return good - bad


def scores(docs: DataFrame, model: dict | None) -> DataFrame:
    common.ship(docs.sparkSession)

    def rows(batches):
        for b in batches:
            ids = b.column("doc_id")
            for t in tk.slices(b.column("text")):
                s = np.full(t.n, 0.5) if model is None else 1 / (1 + np.exp(-np.clip(log_odds(model, statistics(t)), -500, 500)))
                yield pa.record_batch([ids.slice(t.first, t.n), pa.array(s)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")


def op4_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
