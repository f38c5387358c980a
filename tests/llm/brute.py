"""Plain versions to hold the operators against."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, n: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def jaccard_groups(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """(doc_id, set size, smallest reachable doc_id), sorted."""
    sets = [(d, shingles(t)) for d, t in rows]
    holders = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].add(i)
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    done = {}
    for i, (d, s) in enumerate(sets):
        if not s or s in done:
            if s:
                a, b = find(d), find(done[s])
                parent[max(a, b)] = min(a, b)
            continue
        done[s] = d
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j > i:
                    shared[j] += 1
        for j, n in shared.items():
            e, t = sets[j]
            if 100 * n >= 80 * (len(s) + len(t) - n):
                a, b = find(d), find(e)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, s in sets)
