"""Readers and writers: what is written comes back equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.operators import cleaning, distribution, tags, terms
from ticketloom.operators.counts import topic_spine
from ticketloom.operators.scale import shared_folder, stored
from ticketloom.plans import prepare, summaries
from ticketloom.registry import bindings as b
from ticketloom.registry.core import ASSIGN, CENTROIDS, SPINE, SUMMARY_TEXTS, SYSTEMS, TERMS, query, with_
from ticketloom.registry.texts import _COSINE, _NAMES, _documents
from ticketloom.sources import readers, runs, writers


# Texts with quotes and line ends, in one file that is read in many splits.
_TRICKY = """CASE doc_id % 4 WHEN 0 THEN text || chr(10) || 'diz "sim", e' || chr(10) || '"' WHEN 1 THEN '"' || text ELSE text END"""


def _written_tickets(spark, sf, copies=False):
    text = (
        F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit('\ndiz "sim", e\n"')))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('"'), "text"))
        .otherwise(F.col("text"))
    )
    docs = b.table(spark, sf, "documents")
    raw = docs.select(
        (F.col("doc_id") % 300 if copies else F.col("doc_id")).alias("Id"),
        text.alias("Descrição do chamado"),
        F.col("lang").alias("sistema"),
        "n_chars",
        "doc_id",
    )
    folder = shared_folder(spark)
    # Files follow each other by doc_id; each is large enough for many splits, which are read apart.
    writers.write_csv(raw.orderBy("doc_id").drop(*([] if copies else ["doc_id"])), folder)
    return folder


MOST_TASKS = 400


def _in_splits(spark, size, read):
    """A read of files in splits of a given size; the session's own settings come back.

    However many splits there are, about ``MOST_TASKS`` tasks read them, each several splits.
    """
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.maxPartitionNum": str(MOST_TASKS)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return stored(read())
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS "Id", {_TRICKY} AS "Descrição do chamado", lang AS sistema,
  CAST(n_chars AS VARCHAR) AS n_chars FROM documents""")
def csv_roundtrip(spark, sf):
    """Files in splits of 64 kB, most of which begin inside a record."""
    folder = _written_tickets(spark, sf)
    return _in_splits(spark, 65_536, lambda: readers.read_tickets(spark, folder))


@query(f"""
SELECT id, text, position FROM (
  SELECT CAST(doc_id % 300 AS VARCHAR) AS id, {_TRICKY} AS text,
    row_number() OVER (ORDER BY doc_id) - 1 AS position,
    row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id) AS place FROM documents) WHERE place = 1""")
def csv_first_rows(spark, sf):
    """The first row of every id of a written file, by the place it was read from."""
    folder = _written_tickets(spark, sf, copies=True)
    rows = _in_splits(spark, 65_536, lambda: readers.read_tickets(spark, folder, position="position"))
    named = rows.select(F.col("Id").alias("id"), F.col("Descrição do chamado").alias("text"), "position")
    return tags.first_per_id(named, "position")


@query(with_(ASSIGN, CENTROIDS, _COSINE) + """
SELECT system, id, topic AS dominant_topic, topic, prob FROM cosine WHERE prob <> 0""")
def piped_roundtrip(spark, sf):
    folder = shared_folder(spark)
    wide = distribution.wide_distribution(b.own_cosine(spark, sf), b.assignments(spark, sf), 10)
    writers.write_csv(wide, folder, "|")
    back = distribution.long_distribution(readers.read_piped(spark, folder))
    return back.where("prob <> 0").withColumn("dominant_topic", F.col("dominant_topic").cast("int"))


@query(f"WITH {_NAMES} SELECT name FROM names")
def names_roundtrip(spark, sf):
    """Raw names to a headerless file, through the rules, to lines of text and back."""
    raw, listed = shared_folder(spark), shared_folder(spark)
    b.name_words(spark, sf).write.csv(raw, header=False)
    writers.write_lines(cleaning.name_list(readers.read_names(spark, raw)), listed, "name")
    return cleaning.load_names(readers.read_lines(spark, listed))


@query(with_(ASSIGN, TERMS) + "SELECT system, topic, CAST(rank AS INTEGER) AS rank, term, score FROM terms")
def topic_json_roundtrip(spark, sf):
    folder = shared_folder(spark)
    top = terms.topic_terms(terms.term_weights(_documents(spark, sf)))
    writers.write_topic_json(top, folder)
    back = readers.read_topic_terms(spark, f"{folder}/*")
    system = F.regexp_extract("path", "system=([^/]+)/", 1)
    return back.select(system.alias("system"), "topic", "rank", "term", "score")


@query(with_(ASSIGN, TERMS) + """
SELECT system, topic, chr(10) || 'topico ' || topic || ':' || chr(10) || string_agg(term, ' ' ORDER BY rank) AS value
FROM terms GROUP BY system, topic""")
def topic_text_export(spark, sf):
    """Written as text, one folder a system, and read back in blocks that a heading begins."""
    folder = shared_folder(spark)
    top = terms.topic_terms(terms.term_weights(_documents(spark, sf)))
    writers.write_topic_texts(top, folder)
    return readers.read_topic_blocks(spark, folder)


@query(with_(ASSIGN, SYSTEMS, SPINE, SUMMARY_TEXTS) + """
SELECT s.system, s.topic, trim(t.text) AS text FROM spine s LEFT JOIN titles t ON s.system = t.system AND s.topic = t.topic""")
def topic_text_files(spark, sf):
    """One text file for each topic that has a title; topics without a file have a null text."""
    folder = shared_folder(spark)
    rows = b.titles(spark, sf).select("system", "topic", F.concat(F.lit(" "), "text", F.lit("\n")).alias("value"))
    writers.write_topic_files(rows, folder, "titulo_topic_")
    found = readers.read_topic_texts(spark, folder, "titulo_topic_")
    return topic_spine(b.systems(spark, sf)).join(found, ["system", "topic"], "left")


@query("""
SELECT count(*) AS n_documents, count(DISTINCT lang) AS n_systems, max(n_chars) AS longest, 'cosine' AS metric FROM documents""")
def run_record(spark, sf):
    """A record of figures and parameters, written and read back."""
    folder = shared_folder(spark)
    figures = b.table(spark, sf, "documents").agg(
        F.count(F.lit(1)).alias("n_documents"), F.countDistinct("lang").alias("n_systems"), F.max("n_chars").alias("longest")
    )
    writers.write_record(spark, {**figures.first().asDict(), "metric": "cosine"}, folder)
    return spark.read.json(folder)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text, lang AS system FROM documents")
def split_roundtrip(spark, sf):
    return prepare.split_by_system(
        b.tickets(spark, sf).select("id", "text", "system"), shared_folder(spark)
    )


@query("SELECT doc_id, quality, toxic FROM labels")
def optional_input(spark, sf):
    """A stage table that was never written counts as empty."""
    schema = b.table(spark, sf, "labels").schema
    written = readers.read_if_present(spark, f"{sf}/labels.parquet", schema)
    return written.unionByName(readers.read_if_present(spark, f"{sf}/never_written.parquet", schema))


@query(with_(ASSIGN, SYSTEMS, SPINE, SUMMARY_TEXTS) + """
SELECT s.system, s.topic, CASE WHEN s.topic = 1 THEN 'nova ' || t.text ELSE t.text END AS text
FROM spine s LEFT JOIN titles t ON s.system = t.system AND s.topic = t.topic""")
def resume_after_append(spark, sf):
    """Results of several runs: one repeated, one broken, one that replaces a topic's result.

    Topics without a result are left to do and have no text.
    """
    folder = shared_folder(spark)
    titles = b.titles(spark, sf)
    runs.append_once(titles.where("topic < 2"), folder, "first")
    runs.append_once(titles.where("topic < 2"), folder, "first")
    titles.where("topic = 2").write.parquet(f"{folder}/data/run=broken")  # staged, never committed
    runs.append_once(titles.where("topic >= 2"), folder, "second")
    runs.append_once(titles.where("topic = 1").withColumn("text", F.concat(F.lit("nova "), "text")), folder, "third")
    rows = runs.read_runs(spark, folder, "system string, topic int, text string")
    held = runs.latest(rows, "system", "topic")
    spine = topic_spine(b.systems(spark, sf))
    todo = summaries.pending(spine, held).withColumn("text", F.lit(None).cast("string"))
    return held.unionByName(todo)
