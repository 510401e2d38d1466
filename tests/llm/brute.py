"""Slow, plain versions that the operators are compared with."""

from __future__ import annotations

import re
from collections import defaultdict


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, words=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def near_duplicates(rows, percent=75):
    """{doc_id: (n_shingles, component)} by an inverted index over all shingles."""
    sets = {i: shingles(t) for i, t in rows}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    common = defaultdict(int)
    for ids in index.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[b, a] += 1
    edges = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    found = components(sets, edges)
    return {i: (len(s), found[i]) for i, s in sets.items()}
