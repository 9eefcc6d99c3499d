"""Plain versions of the operators, row by row."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

BLANK, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None) -> frozenset:
    w = re.findall(BLANK, low(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(items: list[tuple]) -> tuple[dict, dict]:
    """Sets, and the smallest linked item, of (key, text)."""
    sets = {k: s for k, t in items if (s := shingles(t))}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for k, s in sets.items():
        shared = Counter(o for g in s for o in at[g])
        for o, c in shared.items():
            if 100 * c >= 75 * (len(s) + len(sets[o]) - c):
                a, b = sorted((root(k), root(o)))
                parent[b] = a
        for g in s:
            at[g].append(k)
    return sets, {k: root(k) for k in sets}


def contamination(text: str | None, items: list[tuple]) -> tuple[int, int, list[str]]:
    """Words, hit words and sorted item ids of a text against (item_id, text)."""
    words = re.findall(ALNUM, low(text))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(ALNUM, low(t))
        k = min(10, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def line_rows(rows: list[tuple]) -> dict:
    """Lines that go, by (doc_id, line number): those with an earlier line of a word-set similarity of at least 0.8. doc_ids are unique."""
    seen, gone = [], set()
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate(t.split("\n")):
            s = frozenset(re.findall(BLANK, low(line)))
            if s:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    gone.add((i, k))
                seen.append(s)
    return gone
