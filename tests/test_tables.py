from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom import names
from ticketloom.functions import keys, times
from ticketloom.operators import columns, counts, scale, selection, tags
from ticketloom.plans import prepare, summaries, topic_tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_ids(spark):
    df = spark.createDataFrame([("12.0",), (" 12",), ("12",), ("1.05",), (None,)], "id string")
    assert [r[0] for r in df.select(keys.clean_id(F.col("id"))).collect()] == ["12", "12", "12", "1.05", None]


def test_hours_and_dates(spark):
    df = spark.createDataFrame(
        [("2024-01-01 00:00", "2024-01-01 00:15"), ("2024-01-01", "2023-12-31 12:00"), ("bad", "2024-01-01")],
        "a string, b string",
    )
    a, b = times.parse_timestamp(F.col("a")), times.parse_timestamp(F.col("b"))
    assert [r[0] for r in df.select(times.hours_between(a, b)).collect()] == [0.2, -12.0, None]
    day = spark.range(1).select(times.parse_timestamp(F.lit("02/01/2024"), "dd/MM/yyyy"))
    assert day.first()[0] == datetime.datetime(2024, 1, 2)


def test_metrics_job(spark):
    raw = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", "2024-01-01 01:00:00", None, None, None, "x"),
         (2, "nope", None, "u", "e", "t", "y")],
        f"`Id` int, `{names.OPENED}` string, `{names.SOLVED}` string, Unidade string, Estado string, "
        "`Time` string, Prioridade string",
    )
    done = prepare.prepare_metrics(raw)
    assert done.columns == ["Id", names.OPENED, names.SOLVED, names.HOURS, "Unidade", "Estado", "Time"]
    first, second = rows(done, "Id")
    assert first[3:] == (1.0, "Não Informado", "Não Informado", "Não Atribuído")
    assert second[1:4] == (None, None, None) and second[4:] == ("u", "e", "t")


def test_column_rules(spark):
    df = spark.createDataFrame([(1, "a", "b")], "z int, `TÍTULO` string, Titulo string")
    assert columns.match_labels(df.columns, ["titulo", "x"]) == ["Titulo"]
    assert columns.description_column(["Id", "Descrição do chamado_x"]) == "Descrição do chamado_x"
    assert columns.description_column(["Id", "Nr Chamado"]) == "Nr Chamado"
    assert columns.description_column(["Id"]) is None
    assert columns.topic_column(["id", "t"]) == "t"
    assert columns.id_column(["id"]) == "id"
    assert columns.preferred_order(df, ["Titulo", "q", "z"]).columns == ["Titulo", "z", "TÍTULO"]
    assert columns.insert_after(df, "z", "n", F.lit(1)).columns == ["z", "n", "TÍTULO", "Titulo"]
    assert columns.insert_after(df, "none", "n", F.lit(1)).columns[-1] == "n"
    empty = columns.require_or_empty(df, {"x": T.DoubleType(), "z": T.IntegerType()})
    assert empty.columns == ["x", "z"] and empty.count() == 0
    assert columns.require_or_empty(df, {"z": T.IntegerType()}) is df
    assert columns.copy_if_missing(df, "w", "z").first()["w"] == 1


def test_filters(spark):
    df = spark.createDataFrame(
        [("EN", None, "abc"), ("en", "En", None), ("FR", "EN", "SRC1"), ("FR", "TOTAIS", "x")],
        "system string, wanted string, team string",
    )
    got = [r[0] for r in df.select(columns.same_system(F.col("system"), F.col("wanted"))).collect()]
    assert got == [True, True, False, True]
    got = [r[0] for r in df.select(columns.team_contains(F.col("team"), F.lit("sr"))).collect()]
    assert got == [False, False, True, False]


def test_tags(spark):
    assignments = spark.createDataFrame(
        [("1.0", "SI A", 2, 0, 5), ("1", "TOT", 1, 1, 0), ("1", "SI A", 2, 0, 9), (" 2", "TOT", 0, 1, 1)],
        "id string, system string, topic int, system_order int, position int",
    )
    got = rows(tags.first_seen_tags(assignments), "id")
    assert got == [("1", ["SIA_2", "TOT_1"], ["SI A", "TOT"]), ("2", ["TOT_0"], ["TOT"])]
    strings = spark.createDataFrame(
        [(1, None), (2, "NAO_CLASSIFICADO"), (3, "A_1"), (4, "A_1, B_2"), (5, "B_2")],
        "id int, topic_tags string",
    )
    lists = strings.select("id", tags.tag_list(F.col("topic_tags")).alias("topic_uids"))
    assert rows(tags.postings(lists), "id", "topic_uid") == [
        ("A_1", 3), ("A_1", 4), ("B_2", 4), ("B_2", 5),
    ]
    # Validity looks at the raw pieces, so ' B_2' is not 'B_2'.
    topics = spark.createDataFrame([("B_2",)], "topic_uid string")
    marked = tags.with_valid_tag(strings, topics)
    assert rows(marked.select("id", "valid"), "id") == [
        (1, False), (2, False), (3, False), (4, False), (5, True),
    ]
    assert rows(tags.mapped_counts(marked)) == [(1, 5)]


def test_first_per_id(spark):
    df = spark.createDataFrame([("7.0", 2, "b"), ("7", 1, "a"), ("8", 3, "c")], "id string, p int, v string")
    assert rows(tags.first_per_id(df, "p").select("id", "v"), "id") == [("7", "a"), ("8", "c")]


def test_indicators_and_layouts(spark):
    table = spark.createDataFrame(
        [("A", 0, "x", 4), ("A", 1, "y", 4), ("A", 2, "z", 0), ("B", 0, "q", 3), ("B", 1, "r", 3)],
        "system string, topic int, title string, n_documents long",
    )
    assert rows(counts.indicators(table), "system") == [
        ("A", 3, 8, 2.7, "x", 4), ("B", 2, 6, 3.0, "q", 3),
    ]
    sizes = {(r.system, r.topic): r["size"] for r in counts.prevalence_scale(table).collect()}
    assert sizes == {("A", 0): 10.0, ("A", 1): 10.0, ("A", 2): 1.0, ("B", 0): 5.0, ("B", 1): 5.0}


def test_review_table_counts(spark):
    systems = spark.createDataFrame([("A", 2), ("B", 1)], "system string, k int")
    assigned = spark.createDataFrame([("A", "1", 0)], "system string, id string, topic int")
    texts = spark.createDataFrame([], "system string, topic int, text string")
    got = rows(topic_tables.review_table(systems, assigned, texts, texts), "system", "topic")
    assert [r[3] for r in got] == [1, 0, None]


def test_selection(spark):
    people = [("A", 0, f"{i:03d}", float(i % 7)) for i in range(100)] + [("A", 1, "x", 0.5)]
    probs = spark.createDataFrame(people, "system string, topic int, id string, prob double")
    core = {r.id for r in selection.core_tickets(probs).collect() if r.topic == 0}
    best = sorted((p for p in people if p[1] == 0), key=lambda p: (-p[3], p[2]))[:30]
    assert core == {p[2] for p in best}
    import hashlib

    rest = sorted(
        (p[2] for p in people if p[1] == 0 and p[2] not in core),
        key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest(),
    )
    periphery = [r.id for r in selection.periphery_tickets(probs).orderBy("rank").collect()]
    assert periphery == rest[:15]


def test_selection_paths_and_prompts(spark):
    tickets = spark.createDataFrame(
        [("A", "1", 3, "um"), ("A", "2", 1, None), ("A", "3", 2, "dois"), ("B", "4", 0, None), ("B", "5", 1, "tres")],
        "system string, id string, position int, text string",
    )
    assigned = tickets.select("system", "id", F.lit(0).alias("topic"))
    probs = spark.createDataFrame([("A", "1", 0, 0.9), ("A", "3", 0, 0.1)], "system string, id string, topic int, prob double")
    chosen = selection.select_tickets(tickets, assigned, probs)
    assert rows(chosen, "system", "number") == [
        ("A", 0, "core", 1, "3", "dois"), ("A", 0, "core", 2, "1", "um"), ("B", 0, "core", 1, "5", "tres"),
    ]
    terms = spark.createDataFrame([("A", 0, 1, "rede", 1.0)], "system string, topic int, rank int, term string, score double")
    prompts = {r.system: r.content for r in summaries.summary_prompts(chosen, terms).collect()}
    assert prompts["A"] == f"Keywords do tópico: 'rede'\n\n{names.CORE_HEADING}\nChamado N1: dois\nChamado N2: um"
    assert prompts["B"].startswith("Keywords do tópico: (não disponível)\n\n")
    none = selection.select_tickets(tickets, assigned, None)
    assert {r.system for r in none.collect()} == {"A", "B"}


def test_drawn_tickets_are_numbered_in_the_order_of_the_draw(spark):
    import hashlib

    tickets = spark.createDataFrame(
        [("A", str(i), i, f"t{i}") for i in range(50)], "system string, id string, position int, text string"
    )
    chosen = selection.select_tickets(tickets, tickets.select("system", "id", F.lit(0).alias("topic")), None)
    drawn = sorted(map(str, range(50)), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    got = {part: [r.id for r in chosen.where(F.col("part") == part).orderBy("number").collect()] for part in ("core", "periphery")}
    assert got == {"core": drawn[:30], "periphery": drawn[30:45]}


def test_salted_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_SHARES", 8)
    many = spark.range(3000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k")
    )
    lookup = many.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.upper("k"))
    joined = scale.salted_join(many, lookup, ["k"], "n", ["row"])
    assert joined.count() == 3000
    assert joined.where(F.upper("k") != F.col("v")).count() == 0
    assert joined.columns == ["k", "row", "v"]
