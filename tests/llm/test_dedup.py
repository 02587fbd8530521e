from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from brute import WHITE, near, roots
from pyspark.sql import functions as F

from ticketloom.llm import extendible, links, metric_join, tensor_minhash


def expected_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[WHITE.sub(" ", text or "")].append(doc_id)
    found = []
    for text, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        found += [(i, first, len(ids), i == first, digest) for i in ids]
    return sorted(found, key=str)


@pytest.mark.parametrize("key", [extendible.text_key, lambda t: F.length(t).cast("long") % 3])
def test_exact_copies(odd, odd_rows, key):
    """Also with keys that collide all the time."""
    got = extendible.exact_dedup(odd, capacity=2, key=key).collect()
    assert sorted(map(tuple, got), key=str) == expected_copies([r[:2] for r in odd_rows])


def test_exact_empty_and_stage(none, odd, odd_rows):
    assert extendible.exact_dedup(none).count() == 0
    kept = extendible.keep_first(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({WHITE.sub(" ", r[1] or "") for r in odd_rows})
    assert extendible.keep_first(none).count() == 0


def test_directory_splits(spark):
    """No bucket but those at the full depth holds more than its capacity, and cells nest."""
    rows = spark.range(5000).select(F.xxhash64("id").alias("key"), F.col("id").alias("keep_id"))
    table = extendible.directory(rows, capacity=64)
    bits = table.first()["bits"]
    held = (
        rows.withColumn("cell", extendible.cell(F.col("key"), bits)).join(table, "cell").groupBy("bucket", "depth").count()
    ).collect()
    assert sum(r["count"] for r in held) == 5000
    assert all(r["count"] <= 64 or r["depth"] == bits for r in held)
    assert len({r["depth"] for r in held}) > 1


def test_directory_names_the_bucket_of_a_link(odd):
    index, table, bits = extendible.build_index(odd, capacity=2)
    found = extendible.routed(index.select("key", F.col("bucket").alias("own")), table, bits).collect()
    assert len(found) == index.count() and all(r["bucket"] == r["own"] for r in found)
    assert len({r["bucket"] for r in found}) > 1
    assert extendible.routed(index.select("key"), table.where("false"), bits).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    got = dict(map(tuple, links.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = roots({n for p in pairs for n in p}, pairs)
    assert got == {n: r for n, r in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("words", [4, 5])
def test_near_documents(small, words):
    rows = {r["doc_id"]: r["text"] for r in small.collect()}
    want, sizes = near(rows, words)
    got = tensor_minhash.near_dedup(small, words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (sizes[i], want[i], want[i] == i) for i in rows
    }


def test_near_groups_in_one_entry(spark):
    """A large group of near copies and many texts that share half of their shingles."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, common = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = {}
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(120)] = word()
        texts[i] = " ".join(copy)
        texts[100 + i] = " ".join(common + [word() for _ in range(rng.randrange(5, 60))])
    want, _ = near(texts, 4)
    got = tensor_minhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_near_odd_rows(odd, none, odd_rows):
    got = tensor_minhash.near_dedup(odd, 4).collect()
    assert len(got) == len(odd_rows)
    of = defaultdict(set)
    for r in got:
        of[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert of[1] == of[2] == of[3] == {(11, 1)} and of[9] == {(n, 8) for n, _ in of[9]}
    assert of[4] == {(0, 4)} and of[5] == {(0, 5)} and of[6] == {(0, 6)}
    assert of[10] == {(1, 10), (2, 10)} and of[None] == {(2, None), (0, None)}
    assert tensor_minhash.near_dedup(none).count() == 0
    stage = tensor_minhash.keep_one_each(odd)
    assert stage.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in stage.collect()) == sorted("1 4 5 6 7 8 10 10 11 12 None None".split())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node int, cell string")


@pytest.mark.parametrize("cell_rows", [2048, 20])
def test_vectors(spark, cell_rows):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        label = int(rng.integers(0, 3))
        v = rng.normal(size=16)
        if rows and i % 3:
            other = rows[int(rng.integers(0, len(rows)))]
            v, label = np.array(other[1]) + rng.normal(size=16) * rng.choice([0, 0.1, 0.2, 0.3]), other[2]
        rows.append((i, [float(np.float32(x)) for x in v], label, 1, "x"))
    matrix = np.array([r[1] for r in rows])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(linked, False)
    want = roots(range(300), zip(*np.nonzero(linked)))
    got = metric_join.near_vectors(vectors(spark, rows), cell_rows=cell_rows).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {
        i: (int(linked[i].sum()), want[i], want[i] == i) for i in range(300)
    }


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1),
        (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2), (1, [1.0, 0.0], 1),
        (None, [1.0, 0.0], 1), (12, [3e38, 1e-40], 1),
    ]
    got = metric_join.near_vectors(vectors(spark, [(*r, 1, "x") for r in rows])).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == sorted(
        [("1", 4, 1), ("2", 4, 1), ("1", 4, 1), ("None", 4, 1), ("12", 4, 1)]
        + [(str(i), 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    )
    assert metric_join.near_vectors(vectors(spark, [])).count() == 0


def test_exploded_keys_are_not_broadcast(odd, monkeypatch):
    """Spark takes the keys of the classes for 64 times fewer than they are."""
    plans, real = {}, tensor_minhash.stored

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(tensor_minhash, "stored", stored)
    tensor_minhash.near_dedup(odd)
    assert "Generate" in plans["members"] and "Broadcast" not in plans["members"]
