"""The operators on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moodtide.llm import common, decontamination, html_extraction, language, line_join, packing, quality_model, quality_rules, registry, setsim, similarity, textkit, token_file, url_filter
from tests.llm import brute
from tests.oracle import rows_of, sql_rows

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, list string, id long, n int, h1 string, spans string"


def words(r: random.Random, n: int, stock: int = 400) -> str:
    return " ".join(f"w{r.randrange(stock)}" for _ in range(n))


def documents(seed: int = 1, n: int = 120) -> list[tuple[int, str | None]]:
    """Unique texts, copies, near copies in a large group, shared passages, shared lines, odd ones."""
    r = random.Random(seed)
    base, passage, line = words(r, 90), words(r, 60), words(r, 14)
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE two"), (5, "\n\nThe end.\n"), (6, words(r, 30_000, 9000)), (7, "éà ö ß\u3000ü"), (8, base)]
    while len(out) < n:
        k, text = len(out), words(r, r.randint(3, 150))
        kind = r.random()
        if kind < 0.25:
            w = base.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "x" + str(r.random())
            text = " ".join(w)
        elif kind < 0.4:
            text = text + "\n" + passage + "\n" + words(r, 5)
        elif kind < 0.6:
            text = line + "\n" + text + "\n" + line.upper()
        elif kind < 0.7:
            text = out[r.randrange(3, len(out))][1] or ""
        out.append((k, text))
    return out


def frame(spark, rows):
    full = [(i, t, "en", "s" if i % 3 else None, len(t or ""), "l", 7, 1, "h", "s") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_says_the_same(spark, name):
    assert rows_of(registry.QUERIES[name](spark, FOLDER)) == sql_rows(registry.ORACLE_SQL[name], FOLDER)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = documents(seed)
    sets, component = brute.components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similarity.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (len(sets.get(i, ())), component.get(i, i)) for i, _ in rows}


def test_near_duplicates_with_small_tiles(spark, monkeypatch):
    """Every later stage takes part: blocks of three, and texts that only link by way of others."""
    monkeypatch.setattr(setsim, "TILE", 3)
    r = random.Random(5)
    chain = words(r, 80, 10**6).split()
    rows = []
    for i in range(40):
        rows.append((i, " ".join(chain)))
        chain[2 * i] = f"new{i}"
    rows += [(100 + i, t) for i, t in documents(9, 60)]
    _, component = brute.components(rows)
    got = {x["doc_id"]: x["component_id"] for x in similarity.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: component.get(i, i) for i, _ in rows}


def test_pairs_of_a_group_come_in_rounds(spark, monkeypatch):
    """Texts that differ from 40 others in three words of four, and so nearly link: a round has only so many pairs of a text."""
    monkeypatch.setattr(setsim, "MORE", 4, raising=False)
    made, written = [], common.written

    def counted(df, label="t"):
        out = written(df, label)
        if label == "tiles":
            made.append(out.count())
        return out

    monkeypatch.setattr(common, "written", counted)
    r = random.Random(3)
    base = words(r, 104, 10**6).split()
    rows = []
    for i in range(121):
        x, y = divmod(i, 11)
        w = base[:]
        for k, v in ((20, x), (40, y), (60, (x + y) % 11), (80, (x + 2 * y) % 11)):
            w[k] = f"x{k}y{v}"
        rows.append((i, " ".join(w)))
    _, component = brute.components(rows)
    got = {x["doc_id"]: x["component_id"] for x in similarity.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: component.get(i, i) for i, _ in rows} and len(set(got.values())) == 121
    assert made[0] <= 121 and made[1] <= 4 * 121 and len(made) > 2 and sum(made[1:]) > 1000


@pytest.mark.parametrize("first_lists", [1, 16])
def test_near_duplicates_in_many_rounds(spark, monkeypatch, first_lists):
    for name, v in {"TILE": 3, "MORE": 2, "NEAREST_ROUNDS": 0, "FIRST_LISTS": first_lists}.items():
        monkeypatch.setattr(setsim, name, v)
    r = random.Random(8)
    base = words(r, 60, 10**6).split()
    rows = [(500 + i, t) for i, t in documents(4, 30)]
    for i in range(60):
        w = base[:]
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"n{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    _, component = brute.components(rows)
    got = {x["doc_id"]: x["component_id"] for x in similarity.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: component.get(i, i) for i, _ in rows}


def test_near_duplicates_repeated_and_null_ids(spark):
    """Rows are compared by their own texts, whatever their ids."""
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "q r s t u v w"), (None, "a b c d e f g"), (None, "k l m n o p q"), (None, "k l m n o p q"), (3, None), (3, ""), (4, "q r s t u v w"), (4, "q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in similarity.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (None, None), (None, None), (3, 3), (3, 3), (4, 1), (4, 1)], key=str)
    kept = similarity.one_of_each(df).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:1]) for r in kept) == [("1", "a"), ("1", "q"), ("3", ""), ("3", ""), ("None", "k")]
    same = spark.createDataFrame([(7, "a b c d e f g")] * 3, "doc_id long, text string")
    assert similarity.one_of_each(same).count() == 1 and similarity.near_duplicates(same).count() == 3
    assert similarity.near_duplicates(df.where("doc_id = 77")).count() == 0


def check_lines(spark, rows):
    gone = brute.line_rows(rows)
    got = line_join.without_repeated_lines(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]]
        own = (text or "").split("\n")
        left = [x for k, x in enumerate(own) if (r["doc_id"], k) not in gone]
        assert r["text"] == (text if len(left) == len(own) else "\n".join(left))
        full = sum(bool(re.search(brute.BLANK, x)) for x in own)
        assert (r["n_lines"], r["n_removed"], r["emptied"]) == (full, len(own) - len(left), full > 0 and len(own) - len(left) == full)
        assert r["list"] == "l"


@pytest.mark.parametrize("seed", [1, 3])
def test_repeated_lines(spark, seed):
    check_lines(spark, documents(seed))
    assert line_join.without_repeated_lines(frame(spark, []).limit(0)).count() == 0


def test_repeated_lines_in_many_rounds(spark, monkeypatch):
    """Long lists, several blocks and several rounds: lines of few words that nearly match, and a group of near copies."""
    for name, v in {"LONG_LIST": 8, "LEADERS": 2, "MEMBERS": 5, "MORE": 2, "PAIRS": 50}.items():
        monkeypatch.setattr(line_join, name, v)
    r = random.Random(11)
    base = words(r, 40, 10**6).split()
    rows = []
    for i in range(60):
        w = base[:]
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"n{r.randrange(12)}"
        rows.append((i, "\n".join([" ".join(w), " ".join(r.sample([f"c{k}" for k in range(14)], 10)), words(r, 8, 30)])))
    check_lines(spark, rows)


def test_rounds_read_the_lists_of_open_lines(spark, monkeypatch):
    """A round of verification reads the lists of lines that are still open, not all lists anew, and their sizes come with them."""
    monkeypatch.setattr(line_join, "MORE", 2)
    of_round, r, plain = [], random.Random(5), line_join._next

    def noted(found, open_, take, parts):
        wanted = {(x["a"], x["sub"]) for x in open_.collect()}
        held = [x.asDict() for x in found.collect()]
        lists = {x["list"] for x in held if (x["a"], x["sub"]) in wanted}
        assert all(x["list"] in lists for x in held)
        assert all(n == x["members"] for x in held for n in [sum(y["list"] == x["list"] for y in held)])
        of_round.append(len(held))
        return plain(found, open_, take, parts)

    monkeypatch.setattr(line_join, "_next", noted)
    near = [" ".join(r.sample([f"c{k}" for k in range(14)], 10)) for _ in range(40)]  # most of these pass the filters and few match
    far = [f"{w} z{k}" for w in (words(r, 30, 10**6) for _ in range(40)) for k in range(2)]  # matched at once
    check_lines(spark, list(enumerate([*near, *far])))
    assert len(of_round) > 1 and of_round == sorted(of_round, reverse=True)


def test_lines_are_grouped_without_sorts(spark):
    """Of all lines only counts are grouped; places, whose minima take a sort, are those of repeated lines."""
    keys = spark.createDataFrame([(1, 0, 5, 6), (1, 1, 5, 6), (2, 0, 5, 7), (3, 0, 8, 9), (4, 0, 8, 9), (-1, -5, 8, 9), (7, 9, None, None)], "a long, sub long, h1 long, h2 long")
    equal, scratch = line_join.copies(keys)
    assert {(r["a"], r["sub"]) for r in equal.collect()} == {(1, 1), (4, 0), (-1, -5)}
    assert scratch[0].count() == 5  # not the line that stands once


def test_hashes_of_words():
    """Eight bytes at a time: words are told apart wherever they stand, by their length too."""
    r = random.Random(2)
    some = ["x" * k for k in (1, 7, 8, 9, 15, 16, 17, 300)] + ["\0", "\0\0", "x" * 8 + "\0", "é"] + ["".join(r.choice("abé\0") for _ in range(r.randint(1, 40))) for _ in range(500)]
    seen = {}
    for t in textkit.slices(pa.array([" ".join(some), None, "", " ".join(reversed(some)), "tail"]), limit=3000):
        start, end = t.spans(textkit.BLANK_SEPARATED)
        for a, b, h in zip(start, end, t.word_hashes(start, end).tolist()):
            assert seen.setdefault(t.data[a:b].tobytes(), h) == h
    assert len(seen) == len(set(some)) + 1 == len(set(seen.values()))


def test_repeated_lines_of_odd_ids(spark):
    a, b = "one two three four", "five six seven eight"
    rows = [(1, a), (2, a), (2, b), (None, b), (None, "nine ten"), (5, "x\nx\n\ny"), (5, "x\nx\n\ny"), (6, None), (None, None)]
    df = spark.createDataFrame([(i, t, "n", i) for i, t in rows], "doc_id long, text string, n_lines string, a long")
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["emptied"], r["a"]) for r in line_join.without_repeated_lines(df).collect()), key=str)
    want = [(1, a, 1, 0, False, 1), (2, "", 1, 1, True, 2), (2, b, 1, 0, False, 2), (None, "", 1, 1, True, None), (None, "nine ten", 1, 0, False, None), (5, "x\n\ny", 3, 1, False, 5), (5, "x\n\ny", 3, 1, False, 5), (6, None, 0, 0, False, 6), (None, None, 0, 0, False, None)]
    assert got == sorted(want, key=str)


def test_filters_let_every_match_through():
    """For random sets, some shared word of a matching pair passes all filters."""
    import numpy as np

    r = random.Random(2)
    for _ in range(300):
        x = set(r.sample(range(30), r.randint(1, 25)))
        y = {v if r.random() < 0.93 else r.randrange(60) for v in x}
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        token = [np.sort(np.array([hash_of(v) for v in s], np.uint64)) for s in (x, y)]
        n = np.array([len(t) for t in token])
        prefix, own = line_join.prefix_lengths(n)
        s0, s1 = line_join.signatures(np.concatenate(token), np.array([0, n[0], n[0] + n[1]]))
        ok = False
        for v in set(token[0][: prefix[0]].tolist()) & set(token[1][: prefix[1]].tolist()):
            pos = np.array([token[0].tolist().index(v), token[1].tolist().index(v)])
            m = line_join.Members(np.where(pos < own, n, -n), pos, np.arange(2), n.astype(np.uint64), s0, s1)
            ok |= bool(m.score(np.array([0]), np.array([1]))[0])
        assert ok


def test_bitmaps_never_hide_a_link():
    """Parities that differ, at the narrower width, are no more than the elements in which two sets differ."""
    import numpy as np

    r = np.random.default_rng(4)
    for n in (1, 30, 90, 700):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(len(a) * r.uniform(0.5, 1)))], r.integers(0, 2**63, int(r.integers(0, 2 * n + 1)), dtype=np.uint64)]))
        marks = setsim.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).to_pylist()
        assert setsim.differing(marks[:1], marks[1:])[0] <= len(np.setxor1d(a, b))
        assert setsim.differing(marks[:1], marks[:1])[0] == 0


def hash_of(v: int) -> int:
    return int.from_bytes(hashlib.sha256(str(v).encode()).digest()[:8], "little")


def test_classes_named_alike_are_told_apart(spark):
    df = spark.createDataFrame([(5, 1), (5, 2), (6, 1)], "h1 long, h2 long")
    assert set(setsim.shared_names(df)) == {(5, 1), (5, 2)} and len(set(setsim.shared_names(df).values())) == 2


@pytest.mark.parametrize("python", [True, False])
@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8), (4, 4)], [(0, i) for i in range(1, 60)], [(i, i + 1) for i in range(70)], [((i * 37) % 300, (i * 91) % 290) for i in range(250)], [(i * 7919 % 997, (i + 1) * 7919 % 997) for i in range(400)]])
def test_components(spark, edges, python):
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in common.connected_components(df, python).collect()} == {x: root(x) for x in parent}
    names = df.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    smallest = defaultdict(list)
    for x in parent:
        smallest[root(x)].append(str(x))
    assert {r["node"]: r["component"] for r in common.connected_components(names, python).collect()} == {x: min(v) for v in smallest.values() for x in v}


def test_line_frequency_rejects_depleted(spark):
    r = random.Random(3)
    shared = words(r, 40)
    rows = [(i, shared + "\n" + words(r, 10)) for i in range(30)] + [(i, words(r, 50)) for i in range(30, 40)] + [(50, None), (51, "")]
    df = frame(spark, rows).withColumn("source", F.lit("h"))
    verdict, removed = quality_rules.quality_rules(df)
    kept = {x["doc_id"]: x["kept"] for x in verdict.collect()}
    assert kept == {0: True} | {i: False for i in range(1, 30)} | {i: True for i in range(30, 40)} | {50: False, 51: False}
    assert sorted(x["doc_id"] for x in removed.collect()) == list(range(1, 30))
    assert quality_rules.quality_rules(df.limit(0))[0].count() == 0


def test_line_frequency_of_odd_rows(spark):
    """Repeated rows are one document; null ids, null hosts and names that clash are rows like others."""
    line = "the same line of nine words in every document"
    rows = [(i, line + "\n" + f"u{i} v w x y z a{i} b c d e f{i}") for i in range(12)]
    rows += [rows[3], (3, line + "\nsomething else here"), (None, line + " \n" + line.upper()), (None, None), (20, "")]
    df = spark.createDataFrame([(i, t, None if i == 20 else "h", "line", 1, "x", 2) for i, t in rows], "doc_id long, text string, source string, host string, line int, removed_words string, a long")
    verdict, removed = quality_rules.quality_rules(df)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed_lines"], r["kept"]) for r in verdict.collect())
    want = Counter({(i, 21, i > 0, True): 1 for i in range(12)} | {(3, 21, 1, True): 2, (3, 12, 1, False): 1, (None, 18, 2, False): 1, (None, 0, 0, False): 1, (20, 0, 0, False): 1})
    assert got == want
    assert removed.count() == 11 + 1 + 2
    folder = common.shared_dir(spark) + "/odd-rows"
    df.select("doc_id", "text", "source").write.mode("overwrite").parquet(folder + "/documents.parquet")
    from tests.oracle import sql_rows as sql

    query = quality_rules.ORACLE.replace("FROM documents", f"FROM read_parquet('{folder.removeprefix('file:')}/documents.parquet/*.parquet') documents")
    assert rows_of(verdict) == sql(query, FOLDER)


def test_mixture_finds_both_languages():
    r = random.Random(1)
    say = lambda stock, n: " ".join(r.choice(stock) for _ in range(n))
    stocks = {"aa": "kato mira solu beni taro".split(), "bb": "xyxy wrrt zzgh qqpl vvrt".split(), "cc": "ong eng ing ang ung".split()}
    import numpy as np
    import pyarrow as pa

    from moodtide.llm import textkit

    counts = {}
    for k, stock in stocks.items():
        for t in textkit.slices(pa.array([say(stock, 3000)])):
            counts[k] = np.bincount(language.grams(t)[0], minlength=1 << language.BITS).astype(float)
    model = language.model_of(counts)
    texts = [say(stocks["aa"], 60), say(stocks["bb"], 30) + " " + say(stocks["cc"], 90), None, "12 !!", "é"]
    for t in textkit.slices(pa.array(texts, pa.string())):
        lang, score = language.judge(t, model)
        assert lang[:2].tolist() == ["aa", "cc"] and score[0] > 0.99 and 0.6 < score[1] < 0.9
        assert lang[2:4].tolist() == ["und", "und"] and lang[4] != "und"


def test_mixture_against_plain_em():
    """Weights, sets and scores of a few texts by a plain version of the same model."""
    import math

    import numpy as np

    r = random.Random(4)
    p = np.array([[r.random() ** 3 + 1e-3 for _ in range(4)] for _ in range(30)])
    p /= p.sum(0)
    h = np.array([[r.randrange(4) if r.random() < 0.6 else 0 for _ in range(30)] for _ in range(25)] + [[0] * 30], float)
    h[:20] += np.array([[20 * p[c, i % 4] + 25 * p[c, (i + 1) % 4] * (i % 2) for c in range(30)] for i in range(20)]).round()

    def em(counts, langs):
        w = {k: 1 / len(langs) for k in langs}
        for _ in range(language.EM_STEPS):
            new = dict.fromkeys(langs, 0.0)
            for c, n in enumerate(counts):
                total = sum(w[k] * p[c, k] for k in langs)
                for k in langs if n else ():
                    new[k] += n * w[k] * p[c, k] / total
            w = {k: new[k] / max(sum(counts), 1) for k in langs}
        return w, sum(n * math.log(sum(w[k] * p[c, k] for k in langs) + 1e-300) for c, n in enumerate(counts))

    got = language.infer(h, p)
    for i, counts in enumerate(h.tolist()):
        ll = [sum(n * math.log(p[c, k]) for c, n in enumerate(counts)) for k in range(4)]
        chosen = [max(range(4), key=lambda k: (ll[k], -k))]
        w, score = {chosen[0]: 1.0}, ll[chosen[0]]
        while len(chosen) < 4:
            tries = [(em(counts, sorted([*chosen, k])), k) for k in range(4) if k not in chosen]
            (new_w, new), k = max(tries, key=lambda x: x[0][1])
            if new - score <= language.PENALTY + language.PENALTY_SHARE * sum(counts):
                break
            chosen, w, score = [*chosen, k], new_w, new
        assert np.allclose(got[i], [w.get(k, 0) for k in range(4)], atol=1e-6)
    assert {int((x > 0).sum()) for x in got} >= {1, 2}


def test_language_of_odd_tables(spark):
    say = {"aa": "kato mira solu beni taro", "bb": "xyxy wrrt zzgh qqpl vvrt"}
    rows = [(i, " ".join(t.split()[i % 5 :] * 4), k, "s", 1, "c") for i in range(40) for k, t in say.items()] + [(1, "kato mira solu", None, "s", 1, "c"), (None, "kato mira", "aa", "s", 1, "c"), (1, "a", None, "s", 1, "c"), (2, None, "aa", "s", 1, "c"), (3, "kato " * 200_000, "aa", "s", 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int, h string")
    model = language.fit(language.training_rows(df))
    assert model["langs"] == ["aa", "bb"]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(df, model).collect()]
    assert len(got) == len(rows) and (2, "und", 0.0) in got and (1, "aa", 0.5) in got
    assert all(k == "aa" and v > 0.9 for i, k, v in got if i is None)
    assert language.identify(df.limit(0), model).count() == 0 and language.fit(df.limit(0)) is None
    assert language.identified(df, model).columns == df.columns


def test_language_held_out_accuracy(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = language.op2_mixture_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, all_ = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert all_ > 100 and right > 0.97
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.fit(none) is None
    assert {r["lang_pred"] for r in language.identify(docs.limit(5), None).collect()} == {"und"}


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = common.table(spark, folder, "labels")
    found = quality_model.op4_quadratic_quality(spark, folder).where("held_out").join(labels, "doc_id")
    right = found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0]
    assert right > 0.95
    odd = frame(spark, documents(1, 20))
    assert quality_model.fit(odd, labels.limit(0)) is None
    assert {r["score"] for r in quality_model.scores(odd, None).collect()} == {0.5}


def test_quadratic_scores_against_plain_densities():
    """Statistics, shrunk covariances and log-densities by plain formulas."""
    import numpy as np
    import pyarrow as pa

    from moodtide.llm import textkit

    texts = [t for _, t in documents(6, 60)]
    x = np.concatenate([quality_model.statistics(t) for t in textkit.slices(pa.array(texts, pa.string()))])
    names = list(quality_model.FEATURES)
    for row, text in zip(x, texts, strict=True):
        text = text or ""
        w, raw = re.findall(brute.BLANK, text), text.encode()
        lines = [k for k in text.split("\n") if re.search(brute.BLANK, k)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        want = {
            "log_words": np.log1p(len(w)), "word_length": np.log1p(sum(len(v.encode()) for v in w) / max(len(w), 1)), "log_line_words": np.log1p(len(w) / max(len(lines), 1)),
            "upper": (sum(65 <= c <= 90 for c in raw) / max(len(raw), 1)) ** 0.5, "digit": (sum(48 <= c <= 57 for c in raw) / max(len(raw), 1)) ** 0.5,
            "distinct_words": (len(set(w)) / max(len(w), 1)) ** 0.5, "repeated_windows": (1 - len(set(grams)) / len(grams)) ** 0.5 if grams else 0,
            "repeated_lines": (1 - len(set(lines)) / len(lines)) ** 0.5 if lines else 0, "next_same": (sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1)) ** 0.5,
            "entropy": -sum(n / len(raw) * np.log2(n / len(raw)) for n in Counter(raw).values()) if raw else 0,
        }
        for k, v in want.items():
            assert abs(row[names.index(k)] - v) < 1e-6, (k, text[:50])
    good = np.array([i % 3 > 0 for i in range(len(x))])
    model = quality_model.model_of(x, good)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    pooled = sum((z[good == c] - z[good == c].mean(0)).T @ (z[good == c] - z[good == c].mean(0)) for c in (False, True)) / len(z)
    density = []
    for c in (False, True):
        own = z[good == c]
        d = own - own.mean(0)
        s = 0.8 * d.T @ d / len(own) + 0.2 * pooled
        s = 0.95 * s + 0.05 * np.trace(s) / len(s) * np.eye(len(s))
        e = z - own.mean(0)
        density.append(np.log((len(own) + 1) / (len(z) + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e))
    assert np.allclose(quality_model.log_odds(model, x), density[1] - density[0])


def test_packing_of_odd_rows(spark):
    rows = documents(2, 40) + [(3, "one two")]
    tokenizer = token_file.tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer)
    got = packing.pack(frame(spark, rows), tokenizer).collect()
    want = Counter()
    for i, t in rows:
        ids = encode.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(frame(spark, rows).limit(0), tokenizer).count() == 0


def test_token_files(spark):
    rows = documents(4, 40)
    path = token_file.tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    encode, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows):
        ids = encode.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    got = token_file.token_file(frame(spark, rows), path)
    assert sorted(map(tuple, got.collect())) == want
    twice = token_file.token_file(frame(spark, rows[:6] + rows[:6]).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id"))), path)
    assert twice.count() == 12
    assert token_file.token_file(frame(spark, rows).limit(0), path).count() == 0


@pytest.mark.parametrize("group_bytes", [8 << 20, 300])
def test_decontamination(spark, group_bytes):
    r = random.Random(8)
    items = [(k, words(r, n)) for k, n in enumerate([40, 12, 10, 9, 3, 1, 0, 60])] + [(20, None), (None, words(r, 20)), (0, words(r, 30))]
    long = items[0][1].split()
    texts = [words(r, 50, 10**6) + " " + " ".join(long[3:25]) + "! " + words(r, 9, 10**6), " ".join(long[:9]), " ".join(long[:10]).upper(), items[3][1], "x " + items[4][1] + " " + items[4][1], items[7][1] * 2, None, "", words(r, 200), " ".join(long[:15] + ["zz"] + long[15:30])]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    usable = [(i, t) for i, t in items if i is not None and t]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(frame(spark, rows), bench, group_bytes=group_bytes).collect()
    assert len(got) == len(rows)
    for x in got:
        n, hit, found = brute.contamination(texts[x["doc_id"]], usable)
        assert (x["n_words"], sum(s["end"] - s["first"] for s in x["spans"]), x["items"]) == (n, hit, found)
    clean = decontamination.clean(frame(spark, rows), bench, group_bytes=group_bytes)
    assert {x["doc_id"] for x in clean.collect()} == {i for i, t in enumerate(texts) if not brute.contamination(t, usable)[2]}
    assert decontamination.decontaminate(frame(spark, rows), bench.limit(0)).where("size(items) > 0").count() == 0


def test_decontamination_of_repeated_words(spark):
    """Time and memory are linear in texts of one word, or of few words, again and again."""
    import time

    few = " ".join(["a b a"] * 400)
    rows = [(1, "a " * 1_000_000), (2, few * 3), (3, "b " * 9), (None, "x " + few), (None, None)]
    items = [("i", "a " * 1000), ("j", few), ("k", "b " * 9)]
    began = time.time()
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert time.time() - began < 60
    got = {(x["doc_id"], x["n_words"]): (sum(s["end"] - s["first"] for s in x["spans"]), x["items"]) for x in got}
    assert got[1, 1_000_000] == (1_000_000, ["i"]) and got[3, 9] == (9, ["k"]) and got[None, 1201] == (1200, ["j"]) and got[None, 0] == (0, [])
    n, hit, found = brute.contamination(few * 3, items)
    assert got[2, n] == (hit, found)


def test_url_rules_and_aliases(spark):
    canonical = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://a.net/x", canonical("https://b.com/de/1")), (2, "http://b.net/x?q=1#f", '<meta http-equiv="refresh" content="0; url=http://a.net/x">'), (3, "http://c.net/x", "<link href='/y' rel=canonical>"),
        (4, None, None), (5, "nourl", ""), (6, "http://d.net", canonical("http://z.org/")), (7, "HTTP://Sub.Example.ORG/es/1", None), (8, "http://d.net/", canonical("https://b.com/de/1")),
        (9, "http://example.org/en/12", None), (10, "http://notexample.org/es/", None), (11, "x://h.com/fr", None), (12, "http://A.com/fr/?a#b", None), (1, "http://a.net/x", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages).collect())
    # d.net/ ties the block of b.com/de/1 and the allow of z.org: the allow wins
    want = [
        (1, "a.net", "/x", None, "allow"), (1, "a.net", "/x", None, "allow"), (2, "b.net", "/x", None, "allow"), (3, "c.net", "/x", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "d.net", "", None, "allow"), (7, "sub.example.org", "/es/1", "example.org/es/", "block"), (8, "d.net", "/", None, "allow"), (9, "example.org", "/en/12", "example.org/en/1", "block"),
        (10, "notexample.org", "/es/", "org/", "allow"), (11, "h.com", "/fr", None, "allow"), (12, "a.com", "/fr/", "com/fr/", "allow"),
    ]
    assert got == sorted(want, key=str) or got == want
    alone = url_filter.url_verdicts(pages.where("page_id < 3")).collect()
    assert {r["verdict"] for r in alone} == {"block"}
    extra = spark.createDataFrame([("http://c.net/x", "http://q.com/de/")], "src string, dst string")
    assert [r["verdict"] for r in url_filter.url_verdicts(pages.where("page_id = 3"), edges=extra).collect()] == ["block"]
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_main_text(spark):
    model = html_extraction.fit(html_extraction.labelled_pages(300))
    page = (
        '<html><head><title>t</title><script>var a="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies on this site. <button>OK</button></div>'
        "<article><h1>A  title &amp; more</h1><p>First paragraph with <b>bold\n words</b> and a long enough text to be read by all.<p>Second one, unclosed<br>broken line.<div class=\"ad\">Buy this now</div><p>Caf&eacute;</p></article>"
        '<div id="comments"><p>Reader says nonsense here and there.</p></div><footer>&copy; all rights</footer></body></html>'
    )
    want = "A title & more First paragraph with bold words and a long enough text to be read by all. Second one, unclosed broken line. Café"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<!-- never closed <p>x"), (5, "x", "<p>lone text of a page without any frame around it, and long enough</p>"), (1, "u", page)]
    got = html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] in (2, 3, 4)} == {2: "", 3: "", 4: ""}
    assert next(r["text"] for r in got if r["page_id"] == 5).startswith("lone text")


@pytest.mark.parametrize("unit", ['<a b="', "<a b='", "<p class=x", '<div class="a">', "<div></span>", "<i class=ad>", "<b id=x></i>", "<li>", "<div><li>", "<select>", "<title>", "<!--", "<!x", "</", "< ", "&amp", "<td><p>", "<ul><li><a>", "<x y=z/>", '"<p a=">', "<a = = ", "<textarea></textare>"])
def test_hostile_pages_take_linear_time(unit):
    import time

    model = html_extraction.fit(html_extraction.labelled_pages(30))
    page = "<p>start</p>" + unit * (1_000_000 // len(unit)) + "</div>" * 1000 + "<p>end</p>"
    began = time.time()
    html_extraction.extract(page, model)
    assert time.time() - began < 30


def test_own_data_attributes_teach_nothing():
    model = html_extraction.fit(html_extraction.labelled_pages(60))
    page = '<article><p data-y="x">A first paragraph that is long enough to be read.</p><p data-y="0">And a second one, also long enough to be read by all.</p></article>'
    assert html_extraction.extract(page, model) == html_extraction.extract(page.replace(' data-y="x"', "").replace(' data-y="0"', ""), model) != ""


def test_marginals_equal_enumeration():
    import itertools
    import math

    model = html_extraction.fit(html_extraction.labelled_pages(60))
    t = html_extraction.Tree("<body><nav><a href=x>menu</a></nav><article><p>some words of text</p><div class=ad>ad</div></article></body>")
    amount, share = t.traits()
    n, total, on = len(t.parent), 0.0, [0.0] * len(t.parent)
    for y in itertools.product((0, 1), repeat=n):
        lp = model["root"][y[0]]
        for i in range(n):
            lp += sum(table[y[i]][v] for table, v in zip(model["obs"], (t.kind[i], t.hint[i], amount[i], share[i]), strict=True))
            lp += model["edge"][t.kind[i]][y[t.parent[i]]][y[i]] if i else 0
        p = math.exp(lp)
        total += p
        on = [a + p * b for a, b in zip(on, y, strict=True)]
    assert all(abs(a / total - b) < 1e-9 for a, b in zip(on, html_extraction.marginals(t, model), strict=True))


def test_held_out_pages_of_other_layouts():
    model = html_extraction.fit(html_extraction.labelled_pages())
    right = wrong = 0
    for page in html_extraction.labelled_pages(150, seed=123):
        t = html_extraction.Tree(page, labelled=True)
        keep = html_extraction.marginals(t, model)
        for node, text in t.pieces:
            if node >= 0 and text.strip():
                ok = (keep[node] >= 0.5) == (t.label[node] == 1)
                right, wrong = right + ok, wrong + (not ok)
    assert right / (right + wrong) > 0.9
