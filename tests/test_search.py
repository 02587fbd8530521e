from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import nearest, scale, search

DIM = 6


def vectors(n, seed, copies=0):
    """Unit vectors; ``copies`` of them are the same one, so that scores tie."""
    raw = np.random.default_rng(seed).normal(size=(n, DIM))
    raw[:copies] = raw[0]
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def brute(queries, items, k, eligible=None):
    result = []
    for qid, q in queries:
        scored = [
            (-round(float(np.dot(q, v)), 6), iid)
            for iid, v in items
            if eligible is None or eligible(qid, iid)
        ]
        for rank, (score, iid) in enumerate(sorted(scored)[:k], 1):
            result.append((qid, iid, -score, rank))
    return sorted(result)


def shown(found):
    """Rows with scores at six decimals."""
    return sorted((q, i, round(s, 6), r) for q, i, s, r in found.collect())


@pytest.fixture(scope="module")
def sides(spark):
    queries = [(f"q{i:02d}", v) for i, v in enumerate(vectors(23, 1))]
    items = [(f"i{i:03d}", v) for i, v in enumerate(vectors(150, 2, copies=50))]
    q_groups = {qid: ["a", "b"] if i % 2 else ["c"] for i, (qid, _) in enumerate(queries)}
    # A third of the items share one group, some are in two.
    i_groups = {iid: ["a"] if i < 50 else ["b", "c", "b"] if i % 4 else ["d"] for i, (iid, _) in enumerate(items)}
    q = spark.createDataFrame(
        [(qid, v.tolist(), q_groups[qid]) for qid, v in queries],
        "query_id string, embedding array<double>, groups array<string>",
    )
    i = spark.createDataFrame(
        [(iid, v.tolist(), i_groups[iid]) for iid, v in items],
        "item_id string, embedding array<double>, groups array<string>",
    ).repartition(5)
    eligible = lambda a, b: bool(set(q_groups[a]) & set(i_groups[b]))
    return queries, items, q, i, eligible


@pytest.mark.parametrize("block", [1000, 60, 20])
@pytest.mark.parametrize("grouped", [False, True])
def test_every_block_size_is_exact(sides, monkeypatch, block, grouped):
    queries, items, q, i, eligible = sides
    monkeypatch.setattr(nearest, "CELL_ROWS", 8)
    monkeypatch.setattr(nearest, "TILE_QUERIES", 5)
    got = nearest.top_matches(q, i, 7, grouped=grouped, block_rows=block, chunk_rows=6)
    expected = brute(queries, items, 7, eligible if grouped else None)
    assert shown(got) == expected


def test_cells_are_left_out(spark):
    """Queries near one of eight clouds read few of the cells of the others."""
    rng = np.random.default_rng(9)
    points = np.repeat(np.eye(8), 400, axis=0) * 3 + rng.normal(scale=0.05, size=(3200, 8))
    table = spark.createDataFrame([(f"i{i:04d}", v.tolist()) for i, v in enumerate(points)], "item_id string, embedding array<double>")
    asked = table.limit(40).withColumnRenamed("item_id", "query_id")
    found = nearest.cells_read(asked, table, 5).first()
    assert 0 < found["read"] < found["pairs"] / 2
    got = nearest.top_matches(asked, table, 5)
    queries = [(r["query_id"], r["embedding"]) for r in asked.collect()]
    assert shown(got) == brute(queries, [(f"i{i:04d}", v) for i, v in enumerate(points)], 5)


@pytest.mark.parametrize("block", [1000, 160])
def test_sparse_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "CELL_ROWS", 7)
    monkeypatch.setattr(nearest, "TILE_QUERIES", 4)
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((90, 60)) < 0.1, rng.random((90, 60)), 0)
    dense[3:9] = dense[2]
    dense[20] = 0
    form = "array<struct<slot: int, weight: double>>"
    sparse = [[{"slot": int(s), "weight": float(v[s])} for s in np.flatnonzero(v)] for v in dense]
    items = spark.createDataFrame([(f"i{i:02d}", v) for i, v in enumerate(sparse)], f"item_id string, embedding {form}")
    asked = spark.createDataFrame([(f"q{i:02d}", v) for i, v in enumerate(sparse[:30])], f"query_id string, embedding {form}")
    got = nearest.top_matches(asked, items, 6, block_rows=block, chunk_rows=80)
    assert shown(got) == brute([(f"q{i:02d}", v) for i, v in enumerate(dense[:30])], [(f"i{i:02d}", v) for i, v in enumerate(dense)], 6)


def lists(dense):
    """Rows of a matrix as sparse vectors, as a task gets them."""
    entries = [[{"slot": int(s), "weight": float(v[s])} for s in np.flatnonzero(v)] for v in dense]
    return pa.array(entries, pa.list_(pa.struct([("slot", pa.int32()), ("weight", pa.float64())])))


@pytest.mark.parametrize("cost", [0, 4, 10**6])
@pytest.mark.parametrize("floor", [float("-inf"), 0.6])
def test_postings_find_the_best(monkeypatch, cost, floor):
    """With no frequent slot, some or all; with items that share an id, and queries that fit nothing."""
    monkeypatch.setattr(nearest, "ENTRY_COST", cost)
    monkeypatch.setattr(nearest, "TILE_QUERIES", 7)
    monkeypatch.setattr(nearest, "CROWD", 2)
    rng = np.random.default_rng(11)
    dense = np.where(rng.random((400, 50)) < np.linspace(0.01, 0.5, 50), rng.random((400, 50)), 0)
    asked = np.where(rng.random((40, 50)) < 0.1, rng.random((40, 50)), 0)
    asked[5] = 0
    ids = np.array([f"i{i % 390:03d}" for i in range(400)], object)
    parts = [nearest.Sparse(lists(asked[:30])), nearest.Sparse(lists(asked[30:]))]
    (row, item, score), _, _ = nearest._block_best(parts, nearest.Sparse(lists(dense)), ids, 6, floor)
    found = {q: sorted((-round(s, 6), i) for r, i, s in zip(row, item, score) if r == q and s >= floor) for q in range(40)}
    for q in range(40):
        best = {}
        for i, s in zip(ids, dense @ asked[q]):
            best[i] = max(best.get(i, -1), s)
        want = sorted((-round(s, 6), i) for i, s in best.items())[:6]
        assert found[q] == [w for w in want if -w[0] >= floor]


def test_a_block_of_texts_is_opened_once(monkeypatch):
    """Not once for each of its cells and turns: a hundred times as many queries open it no more often."""
    opened, real = [], np.unique
    monkeypatch.setattr(nearest.np, "unique", lambda *a, **b: opened.append(1) or real(*a, **b))
    rng = np.random.default_rng(12)
    items = lists(np.where(rng.random((1000, 300)) < 0.1, rng.random((1000, 300)), 0))
    calls = []
    for n in (10, 1000):
        opened.clear()
        asked = nearest.Sparse(lists(np.where(rng.random((n, 300)) < 0.05, rng.random((n, 300)), 0)))
        nearest._block_best([asked], nearest.Sparse(items), np.arange(1000), 5)
        calls.append(len(opened))
    assert calls[1] <= calls[0]


@pytest.mark.parametrize("grouped", [False, True])
def test_parts_follow_the_size_of_vectors(spark, monkeypatch, grouped):
    """Tickets go through the shuffle once for each chunk of questions: short questions make one, not one for every 512."""
    side = lambda rows, name, n: spark.range(rows).selectExpr(
        f"id AS {name}_id",
        f"transform(sequence(0, {n - 1}), i -> named_struct('slot', cast(id + i AS int), 'weight', 0.5D)) AS {name}_vector",
        *([f"array('a') AS {name}_groups"] if grouped else []),
    )
    asked, offered = side(1200, "query", 3), side(600, "item", 30)

    def tasks():
        pairs = nearest._block_pairs(asked, offered, grouped, nearest.BLOCK_ROWS, nearest.CHUNK_ROWS)
        held = lambda q, i: pa.table({"q": pa.array([q.num_rows]), "i": pa.array([i.num_rows])})
        return pairs.applyInArrow(held, "q long, i long").collect()

    assert [(r["q"], r["i"]) for r in tasks()] == [(1200, 600)]
    monkeypatch.setattr(nearest, "BLOCK_ENTRIES", 6000)
    assert len(tasks()) == 3  # 18,000 numbers of the tickets in blocks of 6,000, the questions in one chunk


def test_small_tables_use_all_cores(spark):
    """Chunks that a task could hold at once are cut until every core has two tasks."""
    side = lambda rows, name: spark.range(rows).selectExpr(f"id AS {name}_id", f"array(0.5D, 0.5D) AS {name}_vector")
    held = lambda q, i: pa.table({"q": pa.array([q.num_rows]), "i": pa.array([i.num_rows])})
    pairs = nearest._block_pairs(side(20_480, "query"), side(3000, "item"), False, nearest.BLOCK_ROWS, nearest.CHUNK_ROWS)
    tasks = pairs.applyInArrow(held, "q long, i long").collect()
    assert len(tasks) == min(10, 2 * spark.sparkContext.defaultParallelism)
    assert sum(r["q"] for r in tasks) == 20_480 and all(r["i"] == 3000 for r in tasks)


def test_repeated_rows_of_a_query_and_an_item():
    """Cells are read for whole parts of queries; an item listed twice counts with its better row, however many queries ask."""
    rng = np.random.default_rng(5)
    dense = rng.normal(size=(1500, 8))
    both, ids = np.concatenate([dense, dense * 0.5]), np.array([f"i{i:04d}" for i in range(1500)] * 2, object)
    column = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
    (row, item, score), _, _ = nearest._block_best([nearest.Plain(column(dense[:300]))], nearest.Plain(column(both)), ids, 4)
    best = np.maximum(dense[:300] @ dense.T, dense[:300] @ dense.T * 0.5)
    for q in range(300):
        want = sorted((-round(s, 6), f"i{i:04d}") for i, s in enumerate(best[q]))[:4]
        assert sorted((-round(s, 6), i) for r, i, s in zip(row, item, score) if r == q) == want


def test_floor_keeps_the_best_above_it(sides):
    queries, items, q, i, _ = sides
    got = nearest.top_matches(q, i, 9, floor=0.5)
    want = [r for r in brute(queries, items, 9) if r[2] >= 0.5]
    assert [r for r in shown(got) if r[2] >= 0.5] == want
    assert min(r[2] for r in shown(got)) >= 0.49


def test_queries_search_in_parts(sides, monkeypatch):
    queries, items, q, i, _ = sides
    monkeypatch.setattr(nearest, "TURN_QUERIES", 5)
    monkeypatch.setattr(nearest, "CELL_ROWS", 8)
    assert shown(nearest.top_matches(q, i, 7)) == brute(queries, items, 7)


def test_fewer_items_than_k_and_missing_vectors(spark, sides):
    _, _, q, i, _ = sides
    few = i.where("item_id < 'i002'").unionByName(
        spark.createDataFrame([("z", None, [])], i.schema)
    )
    for block in (1000, 1):
        got = nearest.top_matches(q, few, 5, block_rows=block)
        assert got.groupBy("query_id").count().where("count = 2").count() == 23


@pytest.mark.parametrize("block", [1000, 2])
def test_repeated_ids_count_once(spark, block):
    items = [("t1", [1.0, 0.0]), ("t1", [1.0, 0.0]), ("t1", [0.0, 1.0]), ("t2", [0.9, 0.0]), ("t3", [0.8, 0.0])]
    queries = [("q", [1.0, 0.0]), ("q", [0.5, 0.0]), ("p", [0.0, 1.0])]
    q = spark.createDataFrame(queries, "query_id string, embedding array<double>").repartition(3)
    i = spark.createDataFrame(items, "item_id string, embedding array<double>").repartition(2)
    got = nearest.top_matches(q, i, 2, block_rows=block, chunk_rows=1)
    assert sorted(map(tuple, got.collect())) == [
        ("p", "t1", 1.0, 1), ("p", "t2", 0.0, 2), ("q", "t1", 1.0, 1), ("q", "t2", 0.9, 2)
    ]


def test_vectors_of_any_length_and_scores_that_are_no_numbers(spark):
    items = [("a", [4e6, 0.0]), ("b", [4e6, 1.0]), ("c", [float("nan"), 0.0])]
    q = spark.createDataFrame([("q", [4e6, 4e6])], "query_id string, embedding array<double>")
    i = spark.createDataFrame(items, "item_id string, embedding array<double>")
    got = nearest.top_matches(q, i, 3)
    assert sorted(map(tuple, got.collect())) == [("q", "a", 1.6e13, 2), ("q", "b", 1.6e13 + 4e6, 1)]


def topic_rows(spark, rows):
    return spark.createDataFrame(rows, "query_id string, topic_uid string, system string, topic_score double, rank int")


def test_generic_topics(spark):
    ranked = topic_rows(
        spark,
        [("1", "G_0", "Geral", 0.60, 1), ("1", "A_0", "A", 0.50, 2), ("1", "G_1", "Geral", 0.61, 3),
         ("2", "G_0", "Geral", 0.40, 1), ("3", "A_0", "A", 0.40, 1), ("3", "A_1", "A", 0.30, 2)],
    )
    kept = {(r.query_id, r.topic_uid) for r in search.specific_first(ranked).collect()}
    assert kept == {("1", "A_0"), ("1", "G_1"), ("2", "G_0"), ("3", "A_0"), ("3", "A_1")}


def unit(*values):
    return (np.array(values) / np.linalg.norm(values)).tolist()


@pytest.fixture(scope="module")
def small_base(spark):
    topics = spark.createDataFrame(
        [("A_0", "A", unit(1, 0.0)), ("A_1", "A", unit(1, 0.5)), ("B_0", "B", unit(0, 1.0)), ("C_0", "C", unit(-1.0, 0))],
        "topic_uid string, system string, embedding array<double>",
    )
    tickets = spark.createDataFrame(
        [("1", ["A_0"], unit(1, 0.1), "Rede", "c1", 2.0), ("2", ["A_0", "B_0"], unit(1, 0.2), "rede 2", "c1", -1.0),
         ("3", ["B_0"], unit(0.1, 1), "Folha", "c2", None), ("4", ["A_1"], unit(1, 0.4), None, "c2", float("nan"))],
        "id string, topic_uids array<string>, embedding array<double>, team string, category string, hours double",
    )
    return topics, tickets


def ask(spark, *rows):
    return spark.createDataFrame(
        rows, "query_id string, embedding array<double>, system_filter string, team_filter string"
    )


def test_filters_and_floors(spark, small_base):
    topics, tickets = small_base
    queries = ask(
        spark,
        ("free", unit(1, 0.0), None, None), ("b", unit(1, 0.3), "b", None), ("all", unit(1, 0.0), "TOTAIS", "REDE"),
        ("none", unit(0, -1.0), None, None), ("nothere", unit(1, 0.0), "Z", None), ("empty", unit(-1, 0.0), None, None),
    )
    chosen = search.chosen_topics(queries, topics, 2, 0.2)
    picked = {(r.query_id, r.topic_uid) for r in chosen.collect()}
    assert picked == {("free", "A_0"), ("free", "A_1"), ("b", "B_0"), ("all", "A_0"), ("all", "A_1"), ("empty", "C_0")}
    found = search.similar_tickets(queries, topics, tickets, k=2, k_topics=2)
    got = {q: [r.id for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] for q in ("free", "b", "all", "empty")}
    assert got == {"free": ["1", "2"], "b": ["2", "3"], "all": ["1", "2"], "empty": []}
    systems = {r.query_id: (r.detected_system, r.n_candidates) for r in search.detected_system(queries, chosen, tickets).collect()}
    assert systems == {
        "free": ("A", 3), "b": ("B", 2), "all": ("A", 3), "none": (None, 0), "nothere": ("Z", 0), "empty": ("C", 0),
    }


def test_recommendation(spark, small_base):
    topics, tickets = small_base
    queries = ask(spark, ("x", unit(1, 0.0), None, None), ("y", unit(0, -1.0), None, None))
    answers = {r.query_id: r for r in search.recommend(queries, topics, tickets, k=3).collect()}
    x = answers["x"]
    assert (x.confidence, x.tickets, x.n_tickets, x.modal_category) == ("Alta", ["1", "2", "4"], 3, "c1")
    # All teams occur once: the smallest name; one positive time counts.
    assert (x.modal_team, x.modal_team_n, x.mean_hours, x.concentrated) == ("N/A", 1, 2.0, False)
    y = answers["y"]
    assert (y.confidence, y.best_score, y.tickets, y.n_tickets) == ("Nenhuma", 0.0, [], 0)


def test_tiers(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (0.5,), (0.2,)], "s double")
    tiers = [r[0] for r in df.select(search.confidence(F.col("s"), F.lit(True))).collect()]
    assert tiers == ["Alta", "Média", "Média", "Baixa"]


def test_query_by_id_finds_itself(spark, small_base):
    topics, tickets = small_base
    ids = spark.createDataFrame([(" 2 ",), ("99",)], "id string")
    queries = search.tickets_as_queries(ids, tickets)
    found = search.similar_tickets(queries, topics, tickets)
    assert found.orderBy("rank").first()["id"] == "2"
    assert {r.query_id for r in found.collect()} == {"2"}
