"""The rule-based compound score, text by text and word by word."""

import math

from moodtide.functions.vader import _PUNCTUATION, _STRENGTH, ALPHA, BOOST, CAPS, IDIOMS, NEGATION, NEGATIONS


def _negates(word: str) -> bool:
    return word.replace("'", "") in NEGATIONS or word.endswith("n't")


def _negated(low: list[str], v: float, back: int, i: int) -> float:
    """v after a negation that stands so many words before word i; "never so" and "without doubt" strengthen instead."""
    j = i - back
    if back > 1 and low[j] == "never" and any(w in ("so", "this") for w in low[j + 1 : i]):
        return v * (1.25 if back == 2 else 1.5)
    if back > 1 and low[j] == "without" and "doubt" in low[j + 1 : i]:
        return v
    return v * NEGATION if _negates(low[j]) else v


def _idiom(low: list[str], v: float, i: int) -> float:
    """The valence of an idiom that ends at word i, or begins there and goes on; v if there is none. Dampers of two words before it count."""
    for n in (3, 2):
        for at in (i - n + 1, i):
            if at >= 0 and at + n <= len(low) and " ".join(low[at : at + n]) in IDIOMS:
                return IDIOMS[" ".join(low[at : at + n])]
    if any(" ".join(low[i - k - 1 : i - k + 1]) in ("kind of", "sort of") for k in (1, 2) if i - k - 1 >= 0):
        return v - BOOST
    return v


def compound(text: str | None, valences: dict[str, float]) -> float:
    """Words of the table take boosts, dampers, capitals, negations, idioms and "least" before them; "but", "!" and "?" weigh the sum."""
    if not text:
        return 0.0
    tokens = [w if len(w) <= 2 or len(x := w.strip(_PUNCTUATION)) <= 2 else x for w in text.split()]  # short ones may be emoticons
    low = [w.lower() for w in tokens]
    hits = [i for i, w in enumerate(low) if w in valences and w not in _STRENGTH]
    if not hits:
        return 0.0
    upper = [w.isupper() for w in tokens]
    mixed = any(upper) and not all(upper)
    out = []
    for i in hits:
        v = valences[low[i]]
        sign = 1 if v > 0 else -1
        if mixed and upper[i]:
            v += sign * CAPS
        for back in (1, 2, 3):
            j = i - back
            if j < 0 or low[j] in valences and low[j] not in _STRENGTH:
                continue
            s = _STRENGTH.get(low[j], 0.0) * (1, 0.95, 0.9)[back - 1]
            if s:
                v += sign * (s + (math.copysign(CAPS, s) if mixed and upper[j] else 0))
            v = _negated(low, v, back, i)
            if back == 3:
                v = _idiom(low, v, i)
        if i and low[i - 1] == "least" and "least" not in valences and (i == 1 or low[i - 2] not in ("at", "very")):
            v *= NEGATION
        out.append(v)
    if "but" in low:
        at = low.index("but")
        out = [v * (0.5 if i < at else 1.5 if i > at else 1) for i, v in zip(hits, out, strict=True)]
    total = round(math.fsum(out), 9)
    asks = text.count("?")
    loud = min(text.count("!"), 4) * 0.292 + (0 if asks < 2 else asks * 0.18 if asks <= 3 else 0.96)
    total += loud if total > 0 else -loud if total < 0 else 0
    return max(-1.0, min(1.0, total / math.sqrt(total * total + ALPHA))) if total else 0.0
