r"""op13: importance resampling towards a target distribution, on hashed word features.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of A-Z lower-cased texts; features are all runs of ``shortest`` to ``longest`` words, joined by
one space, with repeats; a feature's bucket is the unsigned crc32 of its bytes modulo ``buckets``.

1. ``automaton``: bytes of an Arrow buffer are classified by a lookup table; words begin and end where the class differs from its neighbour's. A
   table-driven CRC goes through all words of a slice at once, one byte of each a step, the longest first, so that a step is a prefix of
   the arrays. Longer runs of words take their states further, through a space and the next word.
2. Bucket counts of the corpus and the target are arrays of a fixed size, added up by bucket. They give each bucket a gain.
3. A second pass adds up each document's gains. Gumbel noise from a hash of the doc_id turns the draw into a ranking.
4. Ranks are a prefix scan over ranges of the score, so no task holds all documents; only the number of documents goes to the driver.

Null, empty and wordless texts have no features and weight 0, and are too short to be drawn. A null doc_id is an empty string in the noise's hash, and comes after
others in ties; rows equal in score and doc_id are drawn one after another. Each row is a document, repeated or not. A word over ``LONG`` bytes takes its CRC from zlib: steps are bounded.
Other columns are ignored. An empty corpus gives an empty result, an empty target counts 0 everywhere.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import common
from moodtide.llm import textkit as tk
from moodtide.operators.scan import scan

BUCKETS, SHORTEST, LONGEST, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 1, 2024, 10, 20
LONG = 256


def _table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 (polynomial 0xEDB88320), by its rule."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (x & np.uint32(1)))
    return x


_STEPS = _table()


def _advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states (before the final inversion) after data[start[i]:end[i]], all runs at once."""
    length = end - start
    order = np.argsort(-np.minimum(length, LONG + 1), kind="stable")
    out, at, left = state[order], start[order], length[order]
    many = int(np.searchsorted(-left, -LONG, "left"))
    for i in range(many):  # few: each has over LONG bytes
        out[i] = zlib.crc32(data[at[i] : at[i] + left[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    live = np.searchsorted(-left[many:], -np.arange(1, 1 + (int(left[many]) if many < len(left) else 0)), "right") + many
    for j, to in enumerate(live.tolist()):
        now = out[many:to]
        out[many:to] = (now >> np.uint32(8)) ^ _STEPS[(now ^ data[at[many:to] + j]) & np.uint32(255)]
    back = np.empty_like(out)
    back[order] = out
    return back


def _features(t: tk.Texts, buckets: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and texts of all features of a lower-cased slice, and the words of each text."""
    start, end = t.spans(tk.ALNUM)
    own, first = t.owner(start), np.arange(len(start))
    state = _advance(np.full(len(start), 0xFFFFFFFF, np.uint32), t.data, start, end)
    found, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, longest + 1):
        if k >= shortest:
            found.append((state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets)
            owners.append(own[first])
        on = first + k < len(own)
        on[on] = own[first[on] + k] == own[first[on]]
        first, state = first[on], state[on]
        if k < longest:
            state = (state >> np.uint32(8)) ^ _STEPS[(state ^ np.uint32(32)) & np.uint32(255)]
            state = _advance(state, t.data, start[first + k], end[first + k])
    return np.concatenate(found), np.concatenate(owners), np.bincount(own, minlength=t.n)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of the features of texts(text); buckets without a feature are absent. A task hands on a row for each bucket at most."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in tk.slices(b.column("text"), lower=True):
                total += np.bincount(_features(t, buckets, shortest, longest)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at), "n": pa.array(total[at])})

    return texts.select("text").mapInArrow(common.lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of each bucket, floor(1000 * ln of the ratio of smoothed shares), from two tables of counts of a fixed size."""
    spark = corpus.sparkSession
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    both = both.union(spark.range(buckets).select("id", F.lit(0).cast("long"), F.lit(0).cast("long"))).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    rows = both.collect()  # a row for each bucket
    s_all, t_all = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    ratio = ((F.col("t") + 1).cast("double") * float(s_all + buckets)) / ((F.col("s") + 1).cast("double") * float(t_all + buckets))
    gained = spark.createDataFrame([(r["bucket"], r["s"], r["t"]) for r in rows], "bucket long, s long, t long").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    return [r["gain"] for r in sorted(gained, key=lambda r: r["bucket"])]


def weighed(docs: DataFrame, gains: list[int], shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches):
        gain = np.array(gains, np.int64)
        for b in batches:
            for t in tk.slices(b.column("text"), lower=True):
                at, own, n_words = _features(t, len(gain), shortest, longest)
                order = np.argsort(own, kind="stable")
                begin = tk.bounds(own[order], t.n)
                columns = (n_words, np.diff(begin), tk.sums(gain[at[order]], begin))
                yield pa.record_batch([b.column("doc_id").slice(t.first, t.n), *(pa.array(c.astype(np.int64)) for c in columns)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(weigh), f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand Gumbel units from the doc_id, as a whole number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs(doc_id, text); rank is null where the row isn't drawn towards target(text)."""
    common.ship(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, buckets, shortest, longest), bucket_counts(target, buckets, shortest, longest), buckets)
    rows = common.written(weighed(docs, gains, shortest, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = scan(able.withColumn("one", F.monotonically_increasing_id()), [F.desc("score"), F.asc_nulls_last("doc_id"), "one"], row="rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    short = rows.where(F.col("n_words") < least_words)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank")).union(short.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH RECURSIVE byte(i, x, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM byte WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS tab FROM byte WHERE k = 8),
texts AS (SELECT row_number() OVER () AS k, doc_id, text, true AS corpus FROM documents UNION ALL SELECT row_number() OVER (), NULL, text, false FROM benchmark),
words AS (SELECT k, corpus, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
feature AS (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % {BUCKETS} AS bucket
            FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM words), crc),
placed AS (SELECT k, corpus, bucket FROM words JOIN feature USING (w)),
total AS (SELECT count(*) FILTER (corpus) AS s_all, count(*) FILTER (NOT corpus) AS t_all FROM placed),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE)))::BIGINT AS g
         FROM (SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM placed GROUP BY 1), total),
weight AS (SELECT k, count(*) AS n, sum(g)::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE corpus GROUP BY 1),
scored AS (SELECT k, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM (SELECT k, doc_id FROM texts WHERE corpus) LEFT JOIN weight USING (k)),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, k) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (k)
"""
