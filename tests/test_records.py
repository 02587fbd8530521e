"""CSV files read by splits against Python's own reader."""

from __future__ import annotations

import csv
import random

import pytest

from ticketloom.sources import readers, records


@pytest.fixture
def small_splits(spark):
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    yield lambda size: spark.conf.set(setting, str(size))
    spark.conf.set(setting, before)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_records_of_split_files(spark, tmp_path, small_splits, size, ending):
    random.seed(size)
    pieces = ["a", 'say "x"', "\n", ",", '"', "é", "\n\n", "long " * 30, ""]
    want = []
    for name in ("a.csv", "b.csv", "c.csv"):
        rows = [[f"{name}{i}", "".join(random.choices(pieces, k=random.randint(0, 6))), "end"] for i in range(60 if name != "c.csv" else 0)]
        rows = [[a, t.replace("\n", ending), e] for a, t, e in rows]
        with open(tmp_path / name, "w", encoding="utf-8", newline="") as out:
            csv.writer(out, lineterminator=ending).writerows([["Id", "t", "z"], *rows])
            out.write(ending)
        want += rows
    small_splits(size)
    got = readers.read_tickets(spark, str(tmp_path), position="place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(120))
    assert [[r["Id"], r["t"] or "", r["z"]] for r in got] == want
    assert size > 1000 or len(records.open_splits(records.lines(spark, str(tmp_path)))) > 0


def test_types_and_repeated_headers(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k,n\n1,"2"\n,\n"a\nb",4', encoding="utf-8")
    got = readers.read_tickets(spark, str(tmp_path / "x.csv"), "k string, n int").collect()
    assert {tuple(r) for r in got} == {("1", 2), (None, None), ("a\nb", 4)}
    (tmp_path / "y.csv").write_text("k,k\n1,2\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_tickets(spark, str(tmp_path / "y.csv")).collect()] == [("1", "2")]
    (tmp_path / "z.csv").write_text("k,n\n", encoding="utf-8")
    assert readers.read_tickets(spark, str(tmp_path / "z.csv")).count() == 0


def test_written_files_and_tasks_follow_the_size(spark, tmp_path, monkeypatch):
    """No task writes or reads the whole table, and a task reads many splits; rows are numbered through all files."""
    from pyspark.sql import functions as F

    from ticketloom.registry import files

    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("a\n"), F.repeat(F.lit("bc "), 80)).alias("text"), F.lit("en").alias("lang"),
        F.lit(9).cast("long").alias("n_chars"),
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    setting, read = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(setting, "false")
    try:
        folder = files._written_tickets(spark, str(tmp_path))
        first = files.csv_first_rows(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(setting)
    assert spark.read.text(folder).select("_metadata.file_path").distinct().count() > 1
    assert sorted((int(r["id"]), r["position"]) for r in first) == [(i, i) for i in range(300)]
    monkeypatch.setattr(files, "MOST_TASKS", 5)
    tasks = []
    files._in_splits(spark, 4096, lambda: (tasks.append(spark.read.text(folder, lineSep="\n").rdd.getNumPartitions()), spark.range(1))[1])
    assert tasks[0] <= 8  # some 40 splits
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == read


def test_splits_are_cut_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('h\n"x\ny"\nz\n', encoding="utf-8")
    cuts = spark.sparkContext.accumulator(0)
    lines = records.lines

    def counted(*args):
        rows = lines(*args)

        def seen(batches):
            for batch in batches:
                cuts.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(seen, rows.schema)

    monkeypatch.setattr(records, "lines", counted)
    monkeypatch.setattr(records, "open_splits", lambda rows: [])
    found = records.numbered(records.without_headers(records.records(spark, str(tmp_path))))
    assert sorted(r["record"] for r in found.collect()) == ['"x\ny"', "z"]
    assert cuts.value == 4
