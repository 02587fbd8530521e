"""Shared-scan fits, runs that are added once, the ledger of stages and the vector store."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ticketloom.operators import lloyd, modeling
from ticketloom.plans import topic_run, vector_store
from ticketloom.sources import runs
from ticketloom.sources.ledger import Ledger, content_digest


def plain_lloyd(rows, centres, most):
    for _ in range(most):
        nearest = ((rows[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        moved = np.stack([rows[nearest == c].mean(0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        done = ((moved - centres) ** 2).sum() <= lloyd.TOLERANCE * rows.var(axis=0, ddof=1).mean()
        centres = moved
        if done:
            break
    return centres, ((rows[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


@pytest.fixture(scope="module")
def cloud(spark):
    rows = np.random.default_rng(1).normal(size=(400, 6)) + np.repeat(np.eye(6)[:4] * 6, 100, axis=0)
    frame = spark.createDataFrame([(r.tolist(),) for r in rows], "x array<double>").repartition(5)
    return rows, frame.select(array_to_vector("x").alias("features"))


def test_shared_scans_equal_single_fits(cloud):
    rows, features = cloud
    data = lloyd.table(features)
    fits = lloyd.started(data, [lloyd.Fit(k, seed, size) for k in (2, 4, 7) for seed in (1, 2) for size in (None, 3)])
    first = [f.centres.copy() for f in fits]
    assert all(len(c) == f.k and c.shape[1] == (f.size or 6) for c, f in zip(first, fits))
    lloyd.moved(data, fits)
    for start, fit in zip(first, fits):
        centres, cost = plain_lloyd(rows[:, : fit.size], start, lloyd.MOST_STEPS)
        assert fit.cost == pytest.approx(cost) and np.allclose(fit.centres, centres)
    again = lloyd.fit_all(features, [(4, 1, None)])[0]
    assert again.cost == pytest.approx(next(f.cost for f in fits if (f.k, f.seed, f.size) == (4, 1, None)))


def test_all_fits_share_their_passes(spark, cloud, monkeypatch):
    """Passes follow the longest fit, not the number of fits."""
    _, features = cloud
    passes = []
    means = lloyd.means
    monkeypatch.setattr(lloyd, "means", lambda *a: passes.append(len(a[1])) or means(*a))
    fits = lloyd.fit_all(features, [(k, seed, None) for k in range(2, 8) for seed in range(10)])
    assert len(passes) == lloyd.INIT_ROUNDS + 2 + max(f.steps for f in fits)
    assert passes[0] == 60 and passes == sorted(passes[:-1], reverse=True) + [60]
    curve = {k: min(f.cost for f in fits if f.k == k) for k in range(2, 8)}
    assert list(curve.values()) == sorted(curve.values(), reverse=True)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "x array<double>").select(array_to_vector("x").alias("features"))
    assert lloyd.fit_all(none, [(3, 1, None)])[0].centres is None
    same = spark.createDataFrame([([1.0, 2.0],)] * 50, "x array<double>").select(array_to_vector("x").alias("features"))
    fit = lloyd.fit_all(same, [(3, 1, None)])[0]
    assert fit.cost == pytest.approx(0) and np.allclose(fit.centres, [[1.0, 2.0]])
    assert {r["prediction"] for r in fit.transform(same).collect()} == {0}


def test_runs_are_added_once(spark, tmp_path):
    path, form = str(tmp_path / "t"), "k int, v string"
    row = lambda *rows: spark.createDataFrame(rows, form)
    assert runs.read_runs(spark, path, form).count() == 0
    assert runs.append_once(row((1, "a"), (2, "b")), path, "one") and not runs.append_once(row((1, "x")), path, "one")
    row((9, "broken")).write.parquet(f"{path}/data/run=two")
    assert {tuple(r)[:2] for r in runs.read_runs(spark, path, form).collect()} == {(1, "a"), (2, "b")}
    assert runs.append_once(row((2, "c"), (None, "d")), path, "two")
    newest = runs.latest(runs.read_runs(spark, path, form), "k")
    assert {tuple(r) for r in newest.collect()} == {(1, "a"), (2, "c"), (None, "d")}


def test_ledger(spark, tmp_path):
    calls = []
    def run(parameter, broken=False):
        ledger = Ledger(spark, str(tmp_path))
        first, _ = ledger.stage("first", 1, {"p": parameter}, ["input"], lambda: calls.append("first"))
        def second():
            calls.append("second")
            if broken:
                raise RuntimeError
            return {"n": 3}
        return ledger.stage("second", 1, {}, [first], second)[1], ledger.made
    assert run(1) == ({"n": 3}, ["first", "second"])
    assert run(1) == ({"n": 3}, []) and calls == ["first", "second"]
    with pytest.raises(RuntimeError):
        run(2, broken=True)
    assert run(2) == ({"n": 3}, ["second"])


def test_content_digest(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert content_digest(rows) == content_digest(rows.repartition(3).orderBy(F.desc("k")))
    assert content_digest(rows) != content_digest(rows.union(rows)) != content_digest(rows.union(rows).union(rows))
    assert content_digest(rows) != content_digest(rows.withColumn("v", F.coalesce("v", F.lit(""))))


def test_only_changed_texts_are_encoded(spark, tmp_path):
    path, seen = str(tmp_path / "v"), []

    def encode(df):
        seen.append(sorted(r["id"] for r in df.collect()))
        return df.withColumn("embedding", F.array(F.length("text").cast("float")))

    docs = spark.createDataFrame([("1", "aa"), ("2", "b"), ("3", None)], "id string, text string")
    read = lambda df, encoder="e": {r["id"]: r["embedding"][0] for r in vector_store.refresh(spark, path, df, encode, encoder).collect()}
    assert read(docs) == {"1": 2.0, "2": 1.0, "3": 0.0}
    changed = docs.where("id <> '2'").union(spark.createDataFrame([("2", "bbb"), ("4", "c")], docs.schema))
    assert read(changed) == {"1": 2.0, "2": 3.0, "3": 0.0, "4": 1.0}
    assert read(changed) == read(changed) and read(docs)["2"] == 1.0
    assert seen == [["1", "2", "3"], ["2", "4"]]
    assert read(docs, "other")["1"] == 2.0 and seen[-1] == ["1", "2", "3"]


def test_topic_run_encodes_texts(spark, tmp_path):
    """Without vectors the built-in encoder steps in; its vectors part four kinds of texts."""
    kinds = ["rede caiu lenta modem", "folha salario pagamento banco", "senha acesso bloqueado login", "impressora papel toner fila"]
    rows = [("A", str(i), f"{kinds[i % 4]} {kinds[i % 4].split()[i % 3]}") for i in range(80)]
    documents = spark.createDataFrame(rows, "system string, id string, text string")
    path = str(tmp_path)
    topic_run.run_all(spark, documents, {"A": 4}, path, minimum=10, n_init_search=2, n_init_final=5, components=(3,), metrics=("cosine",))
    found = {r["id"]: r["topic"] for r in spark.read.parquet(f"{path}/assignments").collect()}
    assert len({(int(i) % 4, t) for i, t in found.items()}) == 4
    assert modeling.best_run(spark.read.parquet(f"{path}/grid")).count() == 1
