"""Plain versions to hold the operators against."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import log10

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WHITE.split((text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def shingles(text, n):
    found = words(text)
    return frozenset(tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))) if found else frozenset()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def near(texts, n):
    """Component of each document (id to text) by all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    where = defaultdict(list)
    shared = Counter()
    for i, s in sorted(sets.items()):
        for x in s:
            for j in where[x]:
                shared[j, i] += 1
            where[x].append(i)
    links = [(i, j) for (i, j), both in shared.items() if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)]
    return roots(sets, links), {i: len(s) for i, s in sets.items()}


class Backoff:
    """A word model read token by token, with dictionaries."""

    def __init__(self, texts):
        self.counts, self.arcs = Counter(), {2: Counter(), 3: Counter()}
        for text in texts:
            tokens = words(text) + [""]
            self.counts.update(tokens)
            for n in (2, 3):
                self.arcs[n].update(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
        self.total, self.distinct = sum(self.counts.values()), len(self.counts)
        self.states = defaultdict(lambda: [0, 0])
        for n in (2, 3):
            for gram, count in self.arcs[n].items():
                self.states[gram[:-1]][0] += count
                self.states[gram[:-1]][1] += 1

    def p(self, state, word):
        if not state:
            return (self.counts[word] + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        if state not in self.states:
            return self.p(state[1:], word)
        count, arcs = self.states[state]
        own = max(self.arcs[len(state) + 1].get((*state, word), 0) - 0.5, 0)
        return own / count + 0.5 * arcs / count * self.p(state[1:], word)

    def score(self, text):
        tokens, found, base = words(text) + [""], 0.0, 0.0
        for i, word in enumerate(tokens):
            found += log10(self.p(tuple(tokens[max(0, i - 2) : i]), word))
            base += log10(self.p((), word))
        return base, found
