"""Each stage of the pipeline on its predecessor's rows, against a plain version."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from brute import WHITE, near, words
from test_scans import packed

import corpus_pipeline
from ticketloom.llm import storage


def plain_targets(sizes):
    """Targets by sharing out again and again what is above twice a source's size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    found, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        for s in free:
            found[s] += unit * weight[s]
        left = sum(max(0.0, found[s] - 2 * sizes[s]) for s in free)
        for s in list(free):
            if found[s] >= 2 * sizes[s]:
                found[s] = 2.0 * sizes[s]
                free.remove(s)
    return found


def test_stages(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, docs: storage.stored(stages[name](spark, docs, ""), name)
    rows = [tuple(r) for r in small.collect()]
    found = step("language_id", small)
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert Counter(map(tuple, found.collect())) == Counter(rows)
    found = step("exact_dedup", found)
    first = {}
    for r in sorted(rows):
        first.setdefault(WHITE.sub(" ", r[1]), r)
    assert sorted(map(tuple, found.collect())) == sorted(first.values())
    found = step("near_dedup", found)
    component, _ = near({r[0]: r[1] for r in first.values()}, 5)
    rows = [r for r in first.values() if component[r[0]] == r[0]]
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    found = step("mix_sources", found)
    taken = Counter(map(tuple, found.collect()))
    assert set(taken) <= set(rows) and max(taken.values()) <= 2
    sizes, mixed, largest = Counter(), Counter(), defaultdict(int)
    for r in rows:
        n = len(words(r[1]))
        sizes[r[3]] += n
        mixed[r[3]] += n * taken[r]
        largest[r[3]] = max(largest[r[3]], n)
    for source, target in plain_targets(sizes).items():
        assert abs(mixed[source] - target) <= largest[source] / 2 + 1e-6
    sequences, total = packed(stages["packing"](spark, found, ""), [r[:2] for r in found.collect()])
    assert sequences <= -(-total // 4096) + 1


@pytest.mark.parametrize("table", ["odd", "none"])
def test_odd_rows_pass_all_stages(spark, request, table):
    docs = request.getfixturevalue(table)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = storage.stored(stage(spark, docs, ""), name)
        assert docs.columns == columns
    corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
