"""Rule-based compound score (Hutto and Gilbert 2014) over a pluggable valence table.

Arrow batches, without a loop over rows or words: tokens of a slice of texts are one dictionary-encoded array, word properties are looked up by entry of the dictionary, and the three words before a
word of the table are shifted arrays. A slice has about a megabyte of text, so that memory goes by its size and not by that of Spark's batches, which hold 10,000 texts of any length. The table is small and its size is checked before it is shipped. The published valences are not part of
this repository: scores follow the rules, and equal the published ones only for the same table.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodtide.functions import lexicon
from moodtide.session import ship

MAX_ENTRIES = 200_000
#: Bytes of text whose tokens are held at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
# Fixed values of the published rules.
BOOST, NEGATION, CAPS, ALPHA = 0.293, -0.74, 0.733, 15.0
BOOSTERS = (
    "absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous enormously entirely especially exceptional exceptionally extreme extremely fabulously flipping flippin "
    "frackin fracking fricking frickin frigging friggin fully fuckin fucking fuggin fugging greatly hella highly hugely incredible incredibly intensely major majorly more most particularly purely quite really "
    "remarkably so substantially thoroughly total totally tremendous tremendously uber unbelievably unusually utter utterly very"
).split()
DAMPERS = "almost barely hardly kinda kindof kind-of less little marginal marginally occasional occasionally partly scarce scarcely slight slightly somewhat sorta sortof sort-of".split()
#: Without their apostrophes; all other words that end in n't negate too.
NEGATIONS = set(
    "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neednt neither never none nope nor not nothing nowhere oughtnt rarely seldom despite shant shouldnt uhuh uh-uh "
    "wasnt werent without wont wouldnt".split()
)
IDIOMS = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9}
_STRENGTH = {**dict.fromkeys(BOOSTERS, BOOST), **dict.fromkeys(DAMPERS, -BOOST)}
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SCALES = (1.0, 0.95, 0.9)


def _table_of(words: pa.Array, table: dict[str, float]) -> np.ndarray:
    """The value of each word, NaN for those that the table lacks."""
    keys = list(table)
    at = pc.index_in(words, pa.array(keys, pa.string()))
    return np.append(np.array([table[k] for k in keys], float), np.nan)[pc.fill_null(at, len(keys)).to_numpy(zero_copy_only=False)]


class _Words:
    """All tokens of a batch: the text and place of each, its number in a dictionary, and properties of the dictionary's entries."""

    def __init__(self, texts: pa.Array, valences: dict[str, float]):
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        flat = split.flatten()
        owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        full = pc.greater(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False)
        encoded = flat.filter(pa.array(full)).dictionary_encode()
        raw, self.owner = encoded.dictionary, owner[full]
        bare = pc.utf8_trim(raw, characters=_PUNCTUATION)  # short ones may be emoticons
        words = pc.if_else(pc.and_(pc.greater(pc.utf8_length(raw), 2), pc.greater(pc.utf8_length(bare), 2)), bare, raw)
        self.low = pc.utf8_lower(words)
        at = encoded.indices.to_numpy()
        self.word = at
        self.valence = _table_of(self.low, valences)[at]
        self.strength = np.nan_to_num(_table_of(self.low, _STRENGTH))[at]
        self.hit = ~np.isnan(self.valence) & (self.strength == 0)
        self.upper = pc.utf8_is_upper(words).to_numpy(zero_copy_only=False)[at]
        negates = pc.or_(pc.is_in(pc.replace_substring(self.low, "'", ""), pa.array(sorted(NEGATIONS))), pc.ends_with(self.low, "n't"))
        self.negates = negates.to_numpy(zero_copy_only=False)[at]
        n = len(texts)
        begin = np.searchsorted(self.owner, np.arange(n + 1))
        self.place, self.left = np.arange(len(at)) - begin[self.owner], begin[1:][self.owner] - np.arange(len(at))  # words before; words from here on
        count = np.bincount(self.owner[self.upper], minlength=n)
        self.mixed = ((count > 0) & (count < np.diff(begin)))[self.owner]

    def number(self, word: str) -> int:
        """The dictionary's entries that are this word, as a mask over all tokens."""
        return pc.equal(self.low, word).to_numpy(zero_copy_only=False)[self.word]


def _before(mask: np.ndarray, i: np.ndarray, back: int, inside: np.ndarray) -> np.ndarray:
    """mask of the words that stand ``back`` before i; false where there are none."""
    return mask[np.maximum(i - back, 0)] & inside


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in order, in runs of at most SLICE_BYTES or of one text."""
    upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE_BYTES, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def compounds(texts: pa.Array, valences: dict[str, float]) -> np.ndarray:
    """The score of each text, slice by slice."""
    return np.concatenate([np.zeros(0), *(_compounds(t, valences) for t in _slices(texts))])


def _compounds(texts: pa.Array, valences: dict[str, float]) -> np.ndarray:
    """Words of the table take boosts, dampers, capitals, negations, idioms and "least" before them; "but", "!" and "?" weigh the sum."""
    w = _Words(texts, valences)
    i = np.flatnonzero(w.hit)
    v = w.valence[i].copy()
    sign, place, mixed = np.where(v > 0, 1.0, -1.0), w.place[i], w.mixed[i]
    v += np.where(mixed & w.upper[i], sign * CAPS, 0.0)
    so, never, without, doubt = w.number("so") | w.number("this"), w.number("never"), w.number("without"), w.number("doubt")
    for back in (1, 2, 3):
        inside = place >= back
        j = np.maximum(i - back, 0)
        free = inside & ~w.hit[j]
        s = w.strength[j] * _SCALES[back - 1]
        v += np.where(free & (s != 0), sign * (s + np.where(mixed & w.upper[j], np.sign(s) * CAPS, 0.0)), 0.0)
        between = range(1, back)
        praised = free & never[j] & np.any([_before(so, i, k, inside) for k in between], axis=0) if back > 1 else np.zeros(len(i), bool)
        sure = free & without[j] & np.any([_before(doubt, i, k, inside) for k in between], axis=0) if back > 1 else np.zeros(len(i), bool)
        v = np.where(praised, v * (1.25 if back == 2 else 1.5), np.where(free & w.negates[j] & ~sure, v * NEGATION, v))
        if back == 3:
            v = _idioms(w, i, v, free)
    if "least" not in valences:
        least, held = w.number("least"), w.number("at") | w.number("very")
        v = np.where(_before(least, i, 1, place >= 1) & ~_before(held, i, 2, place >= 2), v * NEGATION, v)
    but = np.flatnonzero(w.number("but"))[::-1]
    first = np.full(len(texts), -1)
    first[w.owner[but]] = but  # the first of each text is set last
    at = first[w.owner[i]]
    v = np.where(at < 0, v, np.where(i < at, v * 0.5, np.where(i > at, v * 1.5, v)))
    total = np.round(np.bincount(w.owner[i], v, len(texts)), 9)  # sums that differ by rounding alone have one sign
    filled = pc.fill_null(texts, "")
    asks, calls = (pc.count_substring(filled, c).to_numpy(zero_copy_only=False) for c in ("?", "!"))
    loud = np.minimum(calls, 4) * 0.292 + np.where(asks < 2, 0.0, np.where(asks <= 3, asks * 0.18, 0.96))
    total = total + np.sign(total) * loud
    return np.clip(total / np.sqrt(total * total + ALPHA), -1.0, 1.0)


def _idioms(w: _Words, i: np.ndarray, v: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The valence of an idiom that ends at a word, or begins there and goes on; dampers of two words before it count where there is none."""
    found = np.full(len(i), np.nan)

    def holds(words: list[str], shift: int) -> np.ndarray:
        ok = (w.place[i] + shift >= 0) & (w.left[i] >= shift + len(words))
        for k, x in enumerate(words):
            ok &= w.number(x)[np.clip(i + shift + k, 0, max(len(w.word) - 1, 0))]
        return ok

    for n in (3, 2):
        for shift in (1 - n, 0):
            for idiom, value in IDIOMS.items():
                if len(words := idiom.split()) == n:
                    found = np.where(np.isnan(found) & holds(words, shift), value, found)
    damped = np.any([holds([x, "of"], -k - 1) for x in ("kind", "sort") for k in (1, 2)], axis=0)
    return np.where(free, np.where(np.isnan(found), np.where(damped, v - BOOST, v), found), v)


def valence_table(table: DataFrame | None) -> dict[str, float]:
    """The word valences of a table (word, valence), or the seed ones. A table over MAX_ENTRIES is refused."""
    if table is None:
        return dict(lexicon.SEED_VALENCES)
    rows = table.select(F.lower("word"), F.col("valence").cast("double")).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a valence table may hold {MAX_ENTRIES} words")
    return {r[0]: r[1] for r in rows if r[0] is not None and r[1] is not None}


def vader_compound(text: Column, table: DataFrame | None = None) -> Column:
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    valences = valence_table(table)

    @F.arrow_udf(T.DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(compounds(texts, valences))
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a worker that waits for its next task holds nothing
            ctypes.CDLL(None).malloc_trim(0)

    return scored(text)
