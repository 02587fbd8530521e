from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ticketloom.operators import clusters, distribution, lloyd, modeling, scale, terms
from ticketloom.plans import topic_run
from ticketloom.registry import bindings
from ticketloom.sources import readers, writers


@pytest.fixture(scope="module")
def blobs(spark):
    """Three clouds far apart, of 60, 40 and 20 vectors."""
    rng = np.random.default_rng(3)
    rows = []
    for label, size in enumerate((60, 40, 20)):
        centre = np.eye(8)[label] * 5
        rows += [(f"{label}-{i}", label, (centre + rng.normal(scale=0.1, size=8)).tolist()) for i in range(size)]
    return spark.createDataFrame(rows, "id string, truth int, embedding array<double>").repartition(4)


def test_clouds_are_found_and_numbered_by_size(blobs):
    reduced, _ = modeling.reduce_vectors(blobs, 3, "euclidean")
    model, cost = modeling.best_kmeans(reduced, 3, n_init=3)
    topics = modeling.renumbered(model.transform(reduced))
    sizes = {(r.truth, r.topic): r["count"] for r in topics.groupBy("truth", "topic").count().collect()}
    assert sizes == {(0, 0): 60, (1, 1): 40, (2, 2): 20}
    assert cost > 0


def test_same_seed_same_result(blobs):
    reduced, _ = modeling.reduce_vectors(blobs, 3)
    first, second = (modeling.best_kmeans(reduced, 3, n_init=2)[1] for _ in range(2))
    assert math.isclose(first, second)


def test_elbow_falls(blobs):
    costs = [r.wcss for r in modeling.elbow_curve(blobs, range(2, 6), 3, n_init=4).orderBy("k").collect()]
    assert costs == sorted(costs, reverse=True)


def test_grid_prefers_first_best(blobs):
    choice = modeling.grid_search(blobs, 3, components=(2, 3), metrics=("cosine",), n_init=2)
    runs = choice.runs.orderBy("run").collect()
    assert choice.silhouette == max(r.silhouette for r in runs)
    best = modeling.best_run(choice.runs).first()
    assert (best.n_components, best.metric) == (choice.components, choice.metric)
    plain = modeling.grid_search(blobs, 3, components=(3,), metrics=("euclidean",), n_init=2, plain_distances=True)
    assert 0.8 < plain.silhouette < 1


def test_silhouette_equals_the_evaluator(spark, blobs):
    labelled = blobs.select(F.lit("s").alias("system"), F.col("truth").alias("topic"), "embedding")
    own = clusters.silhouette_sq(labelled).first()["silhouette"]
    frame = blobs.select(
        array_to_vector("embedding").alias("features"), F.col("truth").cast("double").alias("prediction")
    )
    assert math.isclose(own, ClusteringEvaluator().evaluate(frame), abs_tol=1e-9)
    lonely = spark.createDataFrame(
        [("s", 0, [0.0, 1.0]), ("s", 1, [1.0, 0.0]), ("s", 1, [1.0, 0.1])],
        "system string, topic int, embedding array<double>",
    )
    assert 0 < clusters.silhouette_sq(lonely).first()["silhouette"] < 1


def test_plain_silhouette_equals_definition(spark):
    rng = np.random.default_rng(5)
    points = [("s" if i % 4 else "t", str(i), int(i % 3 if i % 4 else i % 2), rng.normal(size=4)) for i in range(40)]
    labelled = spark.createDataFrame(
        [(s, i, t, v.tolist()) for s, i, t, v in points], "system string, id string, topic int, embedding array<double>"
    )
    expected = {}
    for system in ("s", "t"):
        own = [p for p in points if p[0] == system]
        scores = []
        for _, i, t, v in own:
            means = {}
            for other in {p[2] for p in own}:
                gaps = [np.linalg.norm(v - p[3]) for p in own if p[2] == other and p[1] != i]
                if gaps:
                    means[other] = np.mean(gaps)
            rest = [m for k, m in means.items() if k != t]
            scores.append((min(rest) - means[t]) / max(min(rest), means[t]) if rest and t in means else 0.0)
        expected[system] = np.mean(scores)
    for block in (100, 7):
        got = clusters.silhouette_euclidean(labelled, block_rows=block).collect()
        assert {r.system: round(r.silhouette, 9) for r in got} == {k: round(v, 9) for k, v in expected.items()}


def test_far_topics_are_not_measured(spark):
    """Ten clouds on a line: a ticket needs its own and its neighbours, and the score is that of all."""
    rng = np.random.default_rng(8)
    points = [(str(i), i % 10, [10.0 * (i % 10) + rng.normal(scale=0.1), rng.normal(scale=0.1)]) for i in range(300)]
    labelled = spark.createDataFrame(
        [("s", i, t, v) for i, t, v in points], "system string, id string, topic int, embedding array<double>"
    )
    work = clusters.silhouette_work(labelled).first()
    assert work["pairs"] == 3000 and work["measured"] <= 900
    x = np.array([v for _, _, v in points])
    gaps, topics = np.linalg.norm(x[:, None] - x[None], axis=2), np.arange(300) % 10
    scores = []
    for i in range(300):
        means = [gaps[i, topics == t].sum() / (30 - (t == topics[i])) for t in range(10)]
        a, b = means[topics[i]], min(m for t, m in enumerate(means) if t != topics[i])
        scores.append((b - a) / max(a, b))
    assert clusters.silhouette_euclidean(labelled, block_rows=16).first()["silhouette"] == pytest.approx(np.mean(scores))


def test_distances_are_held_in_small_parts():
    """A block of any size meets another with a few MB of distances at a time."""
    n, width = 6_000, 4
    values = np.random.default_rng(3).normal(size=(n, width))
    names = pa.array([str(i) for i in range(n)])
    same = lambda kind, value: pa.array([value] * n, kind)
    block = pa.table({
        "system": same(pa.string(), "s"), "id": names, "topic": same(pa.int32(), 0), "other": same(pa.int32(), 0),
        "vector": pa.ListArray.from_arrays(pa.array(range(0, n * width + 1, width), pa.int32()), pa.array(values.ravel())),
    })
    tracemalloc.start()
    got = clusters._gap_sums(block, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000
    assert set(got.column("n").to_pylist()) == {n - 1}
    for at in (0, 41, 42, n - 1):
        assert got.column("total")[at].as_py() == pytest.approx(np.linalg.norm(values - values[at], axis=1).sum())


def test_too_few_topics_have_no_map(spark):
    centroids = spark.createDataFrame(
        [("s", -1, [1.0, 0.0], 5), ("s", 0, [0.0, 1.0], 5), ("s", 1, [1.0, 1.0], 5)],
        "system string, topic int, centroid array<double>, n_documents long",
    )
    assert modeling.topic_coordinates(centroids).count() == 0


TEXTS = [
    ("1", 0, "rede caiu rede lenta rede caiu hoje"), ("2", 0, "rede lenta"), ("3", 1, "folha errada folha paga hoje"),
    ("4", 1, "folha"), ("5", 1, "!!"),
]


def brute_distribution():
    """Definition, ticket by ticket."""
    tokens = {i: t.replace("!!", "").split() for i, _, t in TEXTS}
    words = sorted({w for t in tokens.values() for w in t})
    tf = np.zeros((2, len(words)))
    for i, topic, _ in TEXTS:
        for w in tokens[i]:
            tf[topic, words.index(w)] += 1
    idf = np.log(1 + int(tf.sum(axis=1).mean()) / tf.sum(axis=0))
    topics = tf / tf.sum(axis=1, keepdims=True) * idf
    result = {}
    for i, t in tokens.items():
        runs = [t] if len(t) < 4 else [t[p : p + 4] for p in range(len(t) - 3)]
        total = np.zeros(2)
        for run in runs:
            vector = sum((np.eye(len(words))[words.index(w)] for w in run), np.zeros(len(words))) * idf
            if np.linalg.norm(vector):
                cosine = topics @ vector / np.linalg.norm(vector) / np.linalg.norm(topics, axis=1)
                total += np.where(cosine < 0.1, 0, cosine)
        if total.sum():
            result.update({(i, k): round(v / total.sum(), 4) for k, v in enumerate(total) if v})
    return result


def test_distribution_equals_definition(spark):
    documents = spark.createDataFrame([("s", *row) for row in TEXTS], "system string, id string, topic int, text string")
    weights = terms.term_weights(documents)
    got = {(r.id, r.topic): r.prob for r in distribution.topic_distribution(documents, weights).collect()}
    expected = brute_distribution()
    assert got.keys() == expected.keys()
    assert all(abs(got[key] - expected[key]) < 1e-9 for key in got)
    wide = distribution.wide_distribution(
        distribution.topic_distribution(documents, weights), documents.select("system", "id", "topic"), 2
    )
    assert wide.columns == ["system", "Topico 0", "Topico 1", "id", "dominant_topic"]
    assert wide.where("id = '5'").first()[1:3] == (0.0, 0.0)


def test_distribution_by_common_and_other_words(spark, monkeypatch):
    """Whatever words are common, the result is the same; a text that comes twice counts as once."""
    documents = spark.createDataFrame([("s", *t) for t in TEXTS], "system string, id string, topic int, text string")
    weights = terms.term_weights(documents)
    rest = [("t", "8", "rede caiu"), (None, "9", "rede caiu"), ("s", None, "!!")]
    more = documents.select("system", "id", "text").union(spark.createDataFrame(rest, "system string, id string, text string"))
    expected = brute_distribution()
    for shares in (1, 6, 1_000_000):
        monkeypatch.setattr(distribution, "COMMON_SHARES", shares)
        for given in (more, more.union(more)):
            rows = distribution.topic_distribution(given, weights).collect()
            assert len(rows) == len(expected) and {(r.id, r.topic): r.prob for r in rows} == expected


def test_common_words_do_not_travel():
    """A ticket sends the directory only its words that are not common, each once."""
    word = distribution._Common(pa.array(["b", "a"]), np.ones(2), np.arange(3), np.zeros(2, np.int32), np.ones(2))
    columns = [["s", "t", "s"], ["1", "2", "3"], [7, 8, 9], [["a", "x", "b", "x", "y"], ["a"], ["b"]]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["system", "id", "key", "tokens"])
    got = distribution._coded(batch, {"s": word})
    assert got.column("codes").to_pylist()[1:] == [[-1], [0]] and got.column("rest").to_pylist()[1:] == [["a"], []]
    codes, rest = got.column("codes")[0].as_py(), got.column("rest")[0].as_py()
    assert sorted(rest) == ["x", "y"] and [rest[-1 - c] if c < 0 else "ba"[c] for c in codes] == ["a", "x", "b", "x", "y"]


def test_the_most_frequent_words_are_common(spark, monkeypatch):
    """As many as fit are common, not only those above a share of all words; equal counts stay together."""

    def least(words, counts, topics=1):
        monkeypatch.setattr(distribution, "COMMON_SHARES", words)
        rows = [(f, [0] * topics) for f in counts]
        return distribution._least_count(spark.createDataFrame(rows, "f long, topics array<int>"))

    assert least(4, [9, 9, 1, 1]) == 1  # by share only the nines would be
    assert least(4, [9, 9, 1, 1, 1]) == 9
    assert least(2, [1, 1, 1]) is None and least(2, []) is None
    assert least(4, [9, 2, 2], topics=20) == 9  # two thirds of all words, though its topics are many


def test_place_of_a_word_brings_its_shares_back():
    """Entries come by place in any order, some twice; a word without one counts as nothing."""
    fields = {"place": [2, 0, 2], "idf": [3.0, 1.0, 3.0], "topics": [[1], [0, 1], [1]], "shares": [[0.5], [0.1, 0.2], [0.5]]}
    found = pa.StructArray.from_arrays(
        [pa.array(fields["place"], pa.int32()), pa.array(fields["idf"]), pa.array(fields["topics"], pa.list_(pa.int32())), pa.array(fields["shares"])],
        names=list(fields),
    )
    tokens, idf, table = distribution._entries(np.array([-1, -3, -2, -1], np.int32), found, None)
    assert idf[tokens].tolist() == [1.0, 3.0, 0.0, 1.0]
    assert table[tokens].tolist() == [[0.1, 0.2], [0.0, 0.5], [0.0, 0.0], [0.1, 0.2]]


def test_rows_without_partner_stay_where_they_are(spark):
    """A filter ahead of the join: every partner passes, hardly any other row does."""
    rows = spark.range(2000).selectExpr("CAST(id AS STRING) AS id", "repeat('x', 9) AS text")
    rows = rows.union(rows.where("id = '1'")).union(spark.createDataFrame([(None, "y")], "id string, text string"))
    lookup = spark.createDataFrame([("1",), ("1",), ("7",), (None,), ("none",)], "id string")
    got = scale.likely_matches(rows, lookup, "id")
    assert got.columns == ["id", "text"] and got.where("id IN ('1', '7')").count() == 3
    assert got.where("id IS NOT NULL").count() <= 5


def test_texts_without_a_vector_are_not_moved(spark, tmp_path):
    documents = spark.range(5000).selectExpr("id AS doc_id", "repeat('word ', 50) AS text", "'en' AS lang", "'a' AS source")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(20).selectExpr("id AS vec_id", "array(1f) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assigned = bindings.assigned(spark, str(tmp_path), text_work=True)
    assert assigned.count() == 20
    assert "LeftSemi" in assigned._jdf.queryExecution().optimizedPlan().toString()


def test_topic_run_writes_and_reuses(spark, tmp_path, monkeypatch):
    fitted = topic_run.fitted
    rng = np.random.default_rng(0)
    rows = [
        ("A", str(i), f"palavra{i % 4} comum texto{i % 4}", (np.eye(6)[i % 4] + rng.normal(scale=0.05, size=6)).tolist())
        for i in range(60)
    ] + [("B", "x", "pouco", [0.0] * 6)]
    documents = spark.createDataFrame(rows, "system string, id string, text string, embedding array<double>")
    options = dict(minimum=50, n_init_search=1, n_init_final=3, components=(3,), metrics=("cosine",))
    path = str(tmp_path)
    assert topic_run.run_all(spark, documents, {"A": 4, "B": 2}, path, **options) == ["A"]
    first = {r.id: r.topic for r in spark.read.parquet(f"{path}/assignments").collect()}
    assert len(first) == 60 and set(first.values()) == {0, 1, 2, 3}
    assert spark.read.parquet(f"{path}/coordinates").count() == 4
    totals = spark.read.parquet(f"{path}/distribution").groupBy("id").agg(F.sum("prob").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-3 for r in totals)
    assert spark.read.json(f"{path}/parameters").first()["reused"] is False
    topic_run.run_all(spark, documents, {"A": 4}, path, **options)
    again = spark.read.json(f"{path}/parameters").first()
    assert again["reused"] is True and again["n_components"] == 3 and again["metric"] == "cosine"
    assert {r.id: r.topic for r in spark.read.parquet(f"{path}/assignments").collect()} == first
    # Nothing is fitted for the same rows, other numbers of topics are, and a broken stage is made again.
    made = []
    monkeypatch.setattr(topic_run, "fitted", lambda *a: made.append(a[1]) or fitted(*a))
    topic_run.run_all(spark, documents.repartition(3), {"A": 4}, path, **options)
    assert made == []
    topic_run.run_all(spark, documents, {"A": 3}, path, **options)
    assert made == [3]
    assert {r.topic for r in spark.read.parquet(f"{path}/assignments").collect()} == {0, 1, 2}
    topic_run.run_all(spark, documents.where("id <> '7'"), {"A": 3}, path, **options)
    assert made == [3, 3] and spark.read.parquet(f"{path}/assignments").count() == 59


def test_topic_texts_by_file_name(spark, tmp_path):
    for system, topic, value in (("A", 0, " um \n"), ("A", 11, "dois"), ("B", 3, "")):
        (tmp_path / system).mkdir(exist_ok=True)
        (tmp_path / system / f"titulo_topic_{topic}.txt").write_text(value, encoding="utf-8")
        (tmp_path / system / f"summary_topic_{topic}.txt").write_text("x", encoding="utf-8")
    got = readers.read_topic_texts(spark, str(tmp_path), "titulo_topic_").orderBy("system", "topic").collect()
    assert [tuple(r) for r in got][:2] == [("A", 0, "um"), ("A", 11, "dois")]
    topics = spark.createDataFrame([("A", 0), ("C", 1)], "system string, topic int")
    for prefix, expected in (("titulo_topic_", "um"), ("nothing_", None)):
        found = readers.read_topic_texts(spark, str(tmp_path), prefix)
        joined = topics.join(found, ["system", "topic"], "left").orderBy("system").collect()
        assert [r.text for r in joined] == [expected, None]


def test_tickets_without_a_topic_do_not_count_in_the_silhouette(spark):
    points = [("A", str(i), i % 2, [float(i % 2), i / 100]) for i in range(12)]
    schema = "system string, id string, topic int, embedding array<double>"
    without = clusters.silhouette_euclidean(spark.createDataFrame(points, schema)).collect()
    more = spark.createDataFrame(points + [("A", "x", None, [9.0, 9.0])], schema)
    for block in (1000, 3):
        got = clusters.silhouette_euclidean(more, block_rows=block).collect()
        assert got[0].n_documents == 12
        assert got[0].silhouette == pytest.approx(without[0].silhouette)


def test_topic_json_with_mixed_pairs(spark, tmp_path):
    (tmp_path / "topicos.json").write_text('{"0": [["rede", 0.5], ["", 0.4], ["lenta", 1e-5]], "-1": []}')
    got = readers.read_topic_terms(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.topic, r["rank"], r.term, r.score) for r in got] == [(0, 1, "rede", 0.5), (0, 3, "lenta", 1e-5)]


def test_lines_and_names(spark, tmp_path):
    (tmp_path / "n.txt").write_text("João\n\n  Ana  \n", encoding="utf-8")
    assert sorted(r.name for r in readers.read_lines(spark, str(tmp_path / "n.txt")).collect()) == ["Ana", "João"]
    (tmp_path / "n.csv").write_text("ANA,10\nZÉ\n", encoding="utf-8")
    assert sorted(r.name for r in readers.read_names(spark, str(tmp_path / "n.csv")).collect()) == ["ANA", "ZÉ"]


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b"\nc, d'), ("2", None)], "Id string, t string")
    for separator in (",", "|"):
        path = str(tmp_path / f"x{ord(separator)}")
        writers.write_csv(df, path, separator)
        assert [tuple(r) for r in readers.read_tickets(spark, path, separator=separator).orderBy("Id").collect()] == [
            ("1", 'a "b"\nc, d'), ("2", None),
        ]


def test_registered_models_take_the_defaults(spark, monkeypatch):
    """All systems, and no option that makes a model query smaller than the library's default."""
    from ticketloom.plans import topic_run
    from ticketloom.registry import bindings, models

    folder = "/root/testdata/sf0.01"
    calls = []

    class Stop(Exception):
        pass

    def noted(*args, **options):
        calls.append((args, options))
        raise Stop

    for owner, name, registered in (
        (modeling, "best_kmeans", models.kmeans_topics),
        (modeling, "best_kmeans", models.model_reuse),
        (modeling, "grid_search", models.grid_search),
        (modeling, "elbow_by_system", models.elbow_curve),
        (topic_run, "run_all", models.topic_run_tables),
    ):
        with monkeypatch.context() as patch:
            patch.setattr(owner, name, noted)
            with pytest.raises(Stop):
                registered(spark, folder)
    assert [len(args) for args, _ in calls] == [2, 2, 2, 2, 4]
    assert [options for _, options in calls[:4]] == [{}] * 4 and set(calls[4][1]) <= {"minimum"}
    systems = {r["system"] for r in bindings.assigned(spark, folder).select("system").distinct().collect()}
    assert set(calls[3][0][1]) == set(calls[4][0][2]) == systems


def test_distances_of_many_fits_are_held_fit_by_fit():
    """No table of all centres of all fits at once, and each fit's distances are right."""
    import tracemalloc

    rng = np.random.default_rng(2)
    rows = rng.normal(size=(2048, 5))
    centres = [rng.normal(size=(k, 3 + k % 3)) for k in range(2, 26) for _ in range(10)]
    tracemalloc.start()
    for i, gaps in lloyd._rated(rows, centres):
        if i % 40 == 0:
            own = centres[i]
            want = ((rows[:, None, : own.shape[1]] - own[None]) ** 2).sum(-1)
            assert np.allclose(gaps, want)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # all 3240 centres would take 53 MB
