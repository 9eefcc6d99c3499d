"""The Elias-Fano sequences and the language model against plain versions and SQL."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodtide.llm import elias_fano as ef
from moodtide.llm import ngram_model as m
from moodtide.llm import registry
from tests.llm import brute
from tests.oracle import rows_of, sql_rows


@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (1, 2**64 - 1), (5, 3), (1000, 2**40), (1000, 10), (3000, 2**64 - 1), (50_000, 2**40), (64, 63)])
def test_sequences(n, top):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
    s = ef.Sequence(b"x" * 8 + ef.encode(v), 8)
    assert (s.get(np.arange(n)) == v).all()
    asked = np.concatenate([v, r.integers(0, top, 300, dtype=np.uint64, endpoint=True), np.array([0, top, 2**64 - 1], np.uint64)])
    assert (s.successor(asked) == np.searchsorted(v, asked)).all()
    at, known = s.find(asked)
    assert (known == np.isin(asked, v)).all() and (not n or (v[at[known]] == asked[known]).all())


def test_sequences_are_compact():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 100_000, dtype=np.uint64))
    assert 8 * len(ef.encode(v)) / len(v) < 2.6 + math.log2((1 << 30) / len(v))


def plain(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, units) by dictionaries."""
    q = lambda x: math.floor(math.log10(x) * m.STEPS + 0.5)
    tokens = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, ["", *re.findall(brute.BLANK, brute.low(t)), ""]) for i, t in rows]
    pairs = Counter(p for _, held, w in tokens if not held for p in zip(w, w[1:], strict=False))
    c, t = Counter(), Counter()
    for (v, _), n in pairs.items():
        c[v] += n
        t[v] += 1
    norm = c.total() + len(c) + 1
    out = []
    for i, held, w in tokens:
        units = 0
        for p in zip(w, w[1:], strict=False):
            if p in pairs:
                units += q(pairs[p] - m.DISCOUNT) - q(c[p[0]])
            else:
                units += q(c[p[1]] + 1) - q(norm) + (q(m.DISCOUNT) + q(t[p[0]]) - q(c[p[0]]) if c[p[0]] else 0)
        out.append((i, held, len(w) - 1, sum(c[x] > 0 for x in w[1:]), c.total(), round(sum(math.log10((c[x] + 1) / norm) for x in w[1:]), 6), units / m.STEPS))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    stock = [f"w{i}" for i in range(200)] + ["é", "A", "日本", "x" * 3000]
    rows = [(i, " ".join(r.choice(stock) if r.random() < 0.5 else r.choice(["hot", "hot", "HOT", "pair"]) for _ in range(r.randrange(80)))) for i in range(200)]
    return [*rows, (None, "null id w1"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (300, ""), (301, " \n\t"), (302, "hot " * 50_000), (303, "new words only here"), (-4, "hot pair w3")]


def results(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, shards, slice_bytes, batch", [(1, 4, 4 << 20, 1 << 18), (2, 1, 500, 100), (3, 9, 3000, 1)])
def test_scores_against_dictionaries(spark, monkeypatch, seed, shards, slice_bytes, batch):
    monkeypatch.setattr(m, "SHARDS_PER_TASK", shards)
    monkeypatch.setattr(m, "SLICE", slice_bytes)
    monkeypatch.setattr(m, "BATCH", batch)
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, "t", 1, True) for x in rows], "doc_id int, text string, task string, slice int, learnt boolean").repartition(3)
    out = m.scores(df)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert results(out) == plain(rows)


def test_other_training_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a c d")], "doc_id long, text string")
    none = {r["doc_id"]: r for r in m.scores(df, F.lit(False)).collect()}
    assert none[2]["n_tokens"] == 4 and none[2]["n_known"] == none[2]["train_tokens"] == 0 and none[2]["base_score"] == none[2]["score"] == 0 and none[2]["held_out"]
    some = {r["doc_id"]: r for r in m.scores(df, F.col("doc_id") == 1).collect()}
    assert some[1]["train_tokens"] == 3 and not some[1]["held_out"] and some[1]["score"] > some[2]["score"]
    assert m.scores(df.limit(0)).collect() == []


def test_heavy_words_are_found_and_dealt(spark):
    df = spark.createDataFrame([(i, "hot " * 30 + f"w{i} v{i % 7}") for i in range(100)], "doc_id long, text string")
    total, heavy = m.survey(df)
    assert total == 3300 and len(heavy) >= 2
    layout = m.Layout(8, 4, heavy)
    assert len(np.unique(layout.shard(np.repeat(heavy[:1], 1000), np.arange(1000, dtype=np.uint64)))) == layout.blocks


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    got = registry.QUERIES["op12_elias_fano_trie"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.3


def test_sql_says_the_same_on_a_larger_table(spark):
    folder = "/root/testdata/sf0.01"
    assert rows_of(registry.QUERIES["op12_elias_fano_trie"](spark, folder)) == sql_rows(m.ORACLE, folder)
