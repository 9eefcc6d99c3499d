"""Importance resampling against a plain version, zlib and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from moodtide.llm import registry, resampling
from moodtide.llm import textkit as tk
from tests.llm import brute
from tests.oracle import rows_of, sql_rows

SCHEMA = "doc_id long, text string, rank string, weight int"


def features(text, low, high):
    w = re.findall(brute.ALNUM, brute.low(text))
    return w, [" ".join(w[i : i + k]) for k in range(low, high + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, percent, buckets, low, high, seed, least):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(at(f) for _, x in docs for f in features(x, low, high)[1]), Counter(at(f) for x in target for f in features(x, low, high)[1])
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, x in docs:
        w, f = features(x, low, high)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(at(g)) for g in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(seed=1):
    r = random.Random(seed)
    stock = [*(f"w{i}" for i in range(50)), "Éa", "naïve", "日本語", "A", "ZZ", "x" * 255, "y" * 256, "z" * 257, "q" * 900]
    rows = [(i, r.choice([" ", "-", "\n", "  "]).join(r.choice(stock) for _ in range(r.randrange(60)))) for i in range(150)]
    return [*rows, (None, rows[3][1]), (None, None), (7, rows[7][1]), (7, rows[7][1]), (400, ""), (401, "..."), (402, "v" * 200_000), (403, "long text " * 20_000)]


@pytest.mark.parametrize("low, high, percent, least", [(1, 1, 10, 20), (1, 3, 50, 1), (2, 2, 100, 0)])
def test_against_a_plain_version(spark, low, high, percent, least):
    docs, target = corpus(), ["w1 w2 naïve W3", None, "", "w1 w1 w9", "日本語 éa"]
    df = spark.createDataFrame([(*d, "r", 3) for d in docs], SCHEMA).repartition(4)
    out = resampling.resampled(df, spark.createDataFrame([(x,) for x in target], "text string"), percent, 97, low, high, 11, least)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(docs, target, percent, 97, low, high, 11, least)


def test_crc_of_every_length():
    r = random.Random(3)
    texts = ["".join(r.choice("abcé0日") for _ in range(n)) for n in [*range(1, 300), 5000]]
    t = next(iter(tk.slices(pa.array(texts))))
    found, own, n_words = resampling._features(t, 1 << 32, 1, 1)
    assert (n_words == 1).all() and (own == np.arange(len(texts))).all()
    assert found.tolist() == [zlib.crc32(x.encode()) for x in texts]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert resampling.resampled(empty, empty).collect() == []
    one = spark.createDataFrame([(1, "one two", "r", 3)], SCHEMA)
    assert [tuple(r)[:3] for r in resampling.resampled(one, empty).collect()] == [(1, 2, plain([(1, "one two")], [], 10, 10_000, 1, 1, 2024, 20)[0][2])]


def test_sql_says_the_same_on_a_larger_table(spark):
    folder = "/root/testdata/sf0.01"
    assert rows_of(registry.QUERIES["op13_importance_resampling"](spark, folder)) == sql_rows(resampling.ORACLE, folder)
