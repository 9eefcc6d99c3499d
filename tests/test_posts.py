"""Fixture cases of posts, categories, topics, mood and texts."""

import pytest
from pyspark.sql import functions as F

from moodtide.functions import posts as P
from moodtide.functions import sentiment as S
from moodtide.functions import text as T
from moodtide.functions.vader import BOOSTERS, DAMPERS, IDIOMS, NEGATIONS, compounds, vader_compound
from moodtide.functions.lexicon import MOOD_WORDS, NEGATIVE_WORDS, POSITIVE_WORDS, SEED_VALENCES
from moodtide.operators import posts as O
from moodtide.plans.runs import half_hour_run
from tests.plain_vader import compound

POSTS = [
    (1, "at://a", 1, 1, 1, "2024-01-01T00:00:00Z"), (2, "at://a", 5, 0, 0, "2024-01-01T00:10:00Z"), (3, "at://a", 0, 5, 0, "2024-01-01T00:11:00Z"), (4, "", 99, 0, 0, "2024-01-01T00:12:00Z"),
    (5, "at://post-7", 50, 0, 0, "2024-01-01T00:12:00Z"), (6, "at://b", 7, 0, 0, "not-a-time"), (7, "at://c", 9, 0, 0, "2023-12-31T23:59:59Z"), (8, "at://d", 2, 2, 2, "2024-01-01T09:05:00+09:00"),
]


def posts(spark, rows=POSTS):
    df = spark.createDataFrame(rows, "seq long, uri string, likes long, reposts long, replies long, created_at string")
    return df.withColumns({"text": F.lit("I love it"), "author": F.lit("me"), "cid": F.lit("c"), "created_at": P.parsed_time(F.col("created_at"))})


def test_filter_dedup_rank(spark):
    clean = O.dedup_by_uri(O.since(O.invalidated(posts(spark)), F.lit("2024-01-01T00:00:00Z").cast("timestamp")))
    top = [(r["uri"], r["seq"], r["engagement_score"], r["rank"]) for r in O.top_posts(clean).collect()]
    assert top == [("at://d", 8, 6.0, 1), ("at://a", 2, 5.0, 2)]
    assert sorted(r["uri"] for r in O.dedup_by_uri(clean).collect()) == ["at://a", "at://d"]
    assert [r["uri"] for r in O.top_posts(clean, 1).collect()] == ["at://d"]


def test_lists_have_their_repeats():
    assert (len(POSITIVE_WORDS), len(set(POSITIVE_WORDS))) == (212, 189)
    assert (len(NEGATIVE_WORDS), len(set(NEGATIVE_WORDS))) == (156, 152)
    assert len(MOOD_WORDS) == 100


@pytest.mark.parametrize(
    ("text", "vote"),
    [("I love this new feature! It's amazing!", "positive"), ("This is terrible. I hate it so much.", "negative"), ("The weather is okay today.", "neutral"), ("so unlucky", "positive"), ("a warm reward", "positive"), (None, "neutral"), ("", "neutral")],
)
def test_keyword_vote(spark, text, vote):
    assert spark.createDataFrame([(text,)], "t string").select(S.keyword_sentiment(F.col("t"))).first()[0] == vote


@pytest.mark.parametrize(
    ("text", "topics"),
    [("Great #tech news about #ai development!", ["#tech", "technology", "#ai", "artificial intelligence", "news"]), ("Check out this #music #art piece!", ["#music", "music", "#art", "art"]), ("Just a regular post about nothing special.", []), ("#AI! ##crypto, news. Science", ["#ai!", "artificial intelligence", "##crypto,", "cryptocurrency", "news", "science"]), (None, [])],
)
def test_topics(spark, text, topics):
    assert spark.createDataFrame([(text,)], "t string").select(S.topics(F.col("t"))).first()[0] == topics


@pytest.mark.parametrize(("percent", "index", "word"), [(-100.0, 0, "hopeless"), (-40.0001, 35, "apprehensive"), (-40.0, 30, "worried"), (0.0, 43, "reserved"), (20.0, 55, "pleased"), (40.0, 69, "merry"), (40.0001, 70, "excited"), (100.0, 99, "exalted"), (-250.0, 0, "hopeless"), (250.0, 99, "exalted")])
def test_mood(spark, percent, index, word):
    assert tuple(spark.createDataFrame([(percent,)], "p double").select(S.mood_index(F.col("p")), S.mood_word(F.col("p"))).first()) == (index, word)


def test_labels(spark):
    rows = [(1, None), (2, []), (3, [("porn",)]), (4, [("spoiler",), ("nudity",)]), (5, [("Porn",)])]
    df = spark.createDataFrame(rows, "id int, labels array<struct<val:string>>")
    assert [r["id"] for r in O.without_adult(df).orderBy("id").collect()] == [1, 2, 5]


def test_seed_lexicon_gives_the_unit_categories(spark):
    df = spark.createDataFrame([("I love this new feature! It's amazing!",), ("This is terrible. I hate it so much.",), ("The weather is okay today.",), (None,)], "t string")
    scores = [r[0] for r in df.select(vader_compound(F.col("t"))).collect()]
    assert scores[0] > 0.3 and scores[1] < -0.3 and -0.3 < scores[2] < 0.3 and scores[3] == 0.0
    assert compound("not good", SEED_VALENCES) < 0 < compound("VERY GOOD day!!", SEED_VALENCES)


def test_run_of_no_posts(spark):
    run = half_hour_run(posts(spark, POSTS[:0]), "r", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-01 00:30:00").cast("timestamp"), F.lit(0.5))
    assert tuple(run["overall"].first()) == (0, 0.0, "neutral", 0.0)
    assert run["summary"].first()["should_publish"] is False
    assert run["top"].count() == 0


def test_percent_is_half_even(spark):
    got = spark.createDataFrame([(0.25,), (0.35,), (-3.15,), (None,)], "p double").select(T.percent_format(F.col("p"))).collect()
    assert [r[0] for r in got] == ["+0.2%", "+0.3%", "-3.1%", None]


def test_rules_of_the_compound_score():
    """Each rule moves the score of a plain sentence the way it should."""
    v = {"good": 1.9, "bad": -2.5, "so": 0.0, "heart": 1.0, "death": -2.9, "right": 1.0}
    at = lambda t: compound(t, v)
    assert at("good") == compound("good", {"good": 1.9}) > 0
    assert at("very good") > at("good") > at("barely good") > 0 > at("not good") > at("bad")
    assert at("least good") < 0 < at("at least good") and at("very least good") > 0
    assert at("it was never so good") > at("it was good") and at("without doubt good") == at("good")
    assert at("GOOD day here") > at("good day here") and at("GOOD DAY") == at("good day")
    assert at("the kiss of death") == at("a the kiss of death") != at("a big black death")
    assert at("good but bad") < at("good and bad") and at("good!!!") > at("good!") and at("bad??") < at("bad?")
    assert at("nothing here") == 0 == at("") == at(None)


def test_dedup_keeps_uris_of_null_counters(spark):
    rows = [("a", None, 1, 2, 5), ("a", 3, None, 1, 6), ("b", None, None, None, None), ("c", 1, 1, 1, None), ("c", 1, 1, 1, 9), ("", 9, 9, 9, 1)]
    df = spark.createDataFrame(rows, "uri string, likes long, reposts long, replies long, seq long")
    assert sorted((r["uri"], r["seq"]) for r in O.dedup_by_uri(df).collect()) == [("a", 6), ("b", None), ("c", 9)]


def test_vectorised_scores_equal_plain_ones():
    import random

    import numpy as np
    import pyarrow as pa

    r = random.Random(4)
    stock = [*SEED_VALENCES, *(x.upper() for x in list(SEED_VALENCES)[:9]), *BOOSTERS[:12], *DAMPERS, *sorted(NEGATIONS)[:20], "isn't", "never", "so", "this", "without", "doubt", "least", "at", "very", "but", "BUT", "kind", "sort", "of", *(x for k in IDIOMS for x in k.split()), "table", "Éa", ":)", "!!", "?", "(good)", "x"]
    texts = [None, "", "  ", "good", "Good!", "but", "great \u3000 war", *(r.choice([" ", "\n", "  "]).join(r.choice(stock) + r.choice(["", "", "!", "?", ","]) for _ in range(r.randrange(1, 30))) for _ in range(4000)), *(f"{a} {b} {c} good" for a in ("never", "without", "kind", "very", "") for b in ("so", "doubt", "of", "sort") for c in ("this", "of", "least", "", "BAD"))]
    table = SEED_VALENCES | {"shit": -2.6, "bomb": -2.2, "ass": -2.5, "stop": -1.2, "right": 1.0, "death": -2.9, "die": -2.9, "kiss": 1.8, "heart": 3.2, "broken": -2.1, "doubt": -1.5, ":)": 2.0}
    got = compounds(pa.array(texts, pa.string()), table)
    want = np.array([compound(t, table) for t in texts])
    assert np.abs(got - want).max() < 1e-8 and (want != 0).sum() > 3000
    assert len(compounds(pa.array([], pa.string()), table)) == 0


def test_scoring_holds_the_tokens_of_a_slice_only():
    import tracemalloc

    import pyarrow as pa

    table = {"good": 2.0, "bad": -2.0}
    texts = pa.array([f"a GOOD day {i} but not a bad one! " * (1 + i % 200) for i in range(3000)] + [None, "", "good " * 300_000], pa.string())
    tracemalloc.start()
    got = compounds(texts, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [compounds(texts.slice(i, 1), table)[0] for i in range(0, len(texts), 100)]
    assert len(got) == len(texts) and got[::100].tolist() == want and got[-3:-1].tolist() == [0, 0]
    assert peak < 100_000_000


def test_a_cut_that_ends_in_a_line_break(spark):
    lines = "a" * 200 + "\n" + "b" * 98
    cases = [(lines + "\n" + "c" * 50, lines), (lines + "\r\n" + "c" * 50, "a" * 200), ("a" * 299 + "\n" + "c", "a" * 299), ("\n" * 400, "\n" * 299)]
    df = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "i int, t string").select("i", T.truncate_lines(F.col("t")).alias("cut"))
    assert [r["cut"] for r in df.orderBy("i").collect()] == [w for _, w in cases]
