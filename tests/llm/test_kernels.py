"""Vectorised words, tokens, words of 64 bits and packing plans against plain versions."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodtide.llm import common, packing, setsim, textkit, token_file, tokens
from tests.llm import brute

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("abAB \n\té,.'!1 \x0b| #")), max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_sets(texts):
    for t in textkit.slices(pa.array(texts, pa.string()), lower=True, limit=64):
        start, end = t.spans(textkit.BLANK_SEPARATED)
        own = t.owner(start)
        for i in range(t.n):
            text = texts[t.first + i]
            raw = t.data.tobytes()
            assert [raw[a:b].decode() for a, b, o in zip(start, end, own) if o == i] == re.findall(brute.BLANK, brute.low(text))
        _, edges = textkit.shingle_sets(t.hashes(start, end), own, t.n)
        assert np.diff(edges).tolist() == [len(brute.shingles(x)) for x in texts[t.first : t.first + t.n]]
        ls, le, line_own = t.lines()
        assert [t.data[a:b].tobytes().decode() for a, b in zip(ls, le)] == [x for s in texts[t.first : t.first + t.n] for x in brute.low(s).split("\n")]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=40, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=st.sampled_from(list("abcZ '.,!s\n  \t　\x1cé́0<|>")), max_size=60)), max_size=6))
def test_piecewise_ids_are_the_librarys(name, texts):
    check_ids(name, texts)


PLAIN = {}


def check_ids(name, texts):
    from tokenizers import Tokenizer

    plain = PLAIN.setdefault(name, Tokenizer.from_file(token_file.tokenizer_path(name)))
    e = tokens.encoder(token_file.tokenizer_path(name))
    for _ in range(2):  # the second time from the cache
        for t in textkit.slices(pa.array(texts, pa.string())):
            ids, begin = e.encode(t)
            for i in range(t.n):
                assert ids[begin[i] : begin[i + 1]].tolist() == plain.encode(texts[t.first + i], add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=40, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "a", " b", "\n", "!", "<|", " "]), max_size=9).map("".join), max_size=6))
def test_special_strings_have_their_own_ids(name, texts):
    check_ids(name, texts)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=200))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, literals = token_file.encode_words(v)
    assert (token_file.decode_words(words, literals) == v).all()
    assert len(literals) == sum(x >= 2**60 for x in values)


def test_simple8b_packs_small_values():
    assert len(token_file.encode_words(np.ones(600, np.uint64))[0]) == 10


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    counts = np.zeros(257, np.int64)
    for _ in range(r.choice([0, 1, 5, 3000])):
        counts[min(256, max(1, int(r.lognormvariate(4, 1))))] += 1
    plan, n = packing.packing_plan(counts, 256, 16)
    used, placed = np.zeros(n, np.int64), np.zeros(257, np.int64)
    for length, first, k, offset in plan:
        assert (used[first : first + k] == offset).all()
        used[first : first + k] += length
        placed[length] += k
    assert (placed == counts).all() and used.max(initial=0) <= 256
    least = -(-int((counts * np.arange(257)).sum()) // 256)
    assert least <= n <= least * 1.03 + 2


def test_patterns_place_most_pieces():
    """The whole fit is used, and takes at most a thousandth more sequences than best fit alone."""
    r = np.random.default_rng(3)
    counts = np.bincount(np.clip(r.lognormal(6.3, 1, 30_000).astype(int), 1, 4096), minlength=4097)
    runs, _, left, _ = packing.pattern_runs(counts)
    placed = sum(n for _, _, n, _ in runs)
    assert placed + left.sum() == counts.sum() and placed > 0.5 * counts.sum()
    alone = packing._best_fit(counts.astype(np.int64), 4096, [], 0, [])[1]
    assert packing.packing_plan(counts)[1] <= 1.001 * alone


def test_nnls_is_least_squares_on_the_cone():
    a, b = np.array([[1.0, 0, 1], [0, 1, 1], [1, 1, 0]]), np.array([3.0, 1, -2])
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-9).all() and abs((x * slope).sum()) < 1e-9


def test_a_filter_of_keys_loses_no_row_and_passes_few(spark):
    rows = spark.range(0, 40_000).select((F.col("id") * 7919 - 10_000_000).alias("a"), (F.col("id") % 5).alias("r"), F.col("id").alias("text"))
    keys = rows.where("text % 40 = 3").select("a", "r")
    got = {x["text"] for x in common.probably_among(rows, keys, ["a", "r"]).collect()}
    want = set(range(3, 40_000, 40))
    assert want <= got and len(got) < len(want) + 20
    assert common.probably_among(rows, keys.limit(0), ["a", "r"]).count() == 0


def test_texts_of_pairs_alone_are_moved(spark):
    docs = spark.createDataFrame([(i, i % 2, f"text {i}") for i in range(200)], "a long, r long, text string")
    first = docs.select((F.col("a") + 1000).alias("id"), "a", "r").where("a < 150")
    pairs = spark.createDataFrame([(1003, 1007, 1), (1003, 1009, 1), (1140, 1003, 1)], "c long, x long, xn int")
    got = setsim.texts_of(pairs, docs.union(docs.where("a = 7")), first)
    assert sorted((r["id"], r["text"]) for r in got.collect()) == [(1000 + i, f"text {i}") for i in (3, 7, 9, 140)]


def test_packing_leaves_room_in_a_worker():
    """Ids are made of little text at once, and of what a task needs only the encoder stays in the worker."""
    path = token_file.tokenizer_path("word_bpe_49k.json")
    b = pa.record_batch([pa.array(range(16)), pa.array(["some words that come again, " * 8000] * 16)], names=["doc_id", "text"])
    encoder, rows = tokens.encoder(path), common.lean(packing.piece_rows(path, 1, 4096), encoders=True)
    textkit.forget()
    tracemalloc.start()
    try:
        n = sum(x.num_rows for x in rows([b]))
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert n > 16 and tokens.encoder(path) is encoder
    assert most < 40e6 and kept < 10e6
