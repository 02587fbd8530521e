"""Counts, series, tables and row rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom import names
from ticketloom.functions import keys, text, times
from ticketloom.operators import columns, counts, tags
from ticketloom.operators.scale import shared_folder
from ticketloom.plans import prepare, running_counts, topic_tables
from ticketloom.registry import bindings as b
from ticketloom.registry.core import (
    ASSIGN,
    COUNTS,
    DATED,
    SPINE,
    SUMMARY_TEXTS,
    SYSTEMS,
    TERMS,
    query,
    with_,
)

_MONTHLY = """monthly AS (
  SELECT system, date_trunc('month', opened)::TIMESTAMP AS month, topic, count(*) AS n_tickets
  FROM dated GROUP BY ALL)"""


def _titles(spark, sf):
    return b.titles(spark, sf).withColumnRenamed("text", "title")


def _dated(spark, sf):
    return counts.dated_assignments(b.opened(spark, sf), b.assignments(spark, sf))


@query(with_(ASSIGN, DATED, SYSTEMS, SPINE, SUMMARY_TEXTS, _MONTHLY) + """
SELECT m.system, m.month, m.topic, coalesce(t.text, 'Tópico ' || m.topic) AS title, m.n_tickets
FROM monthly m LEFT JOIN titles t ON m.system = t.system AND m.topic = t.topic""")
def monthly_volume_by_topic(spark, sf):
    return counts.monthly_evolution(_dated(spark, sf), _titles(spark, sf))


@query(with_(ASSIGN, DATED, SYSTEMS, SPINE, SUMMARY_TEXTS, _MONTHLY) + """
SELECT m.system, m.month, m.topic, coalesce(t.text, 'Tópico ' || m.topic) AS title, m.n_tickets
FROM monthly m LEFT JOIN titles t ON m.system = t.system AND m.topic = t.topic
WHERE m.topic IN (3, 7)""")
def monthly_selected_topics(spark, sf):
    return counts.monthly_evolution(_dated(spark, sf), _titles(spark, sf), [3, 7])


@query(with_(ASSIGN, DATED, _MONTHLY) + """
SELECT system, month, CAST(sum(n_tickets) AS BIGINT) AS n_tickets FROM monthly GROUP BY system, month""")
def monthly_total(spark, sf):
    return counts.monthly_total(counts.monthly_evolution(_dated(spark, sf), _titles(spark, sf)))


@query(with_(ASSIGN, DATED, _MONTHLY) + """
SELECT system, month, topic, n_tickets FROM monthly
UNION ALL
SELECT system, month, NULL, CAST(sum(n_tickets) AS BIGINT) FROM monthly GROUP BY system, month""")
def monthly_rollup(spark, sf):
    return counts.monthly_rollup(_dated(spark, sf))


@query("""
SELECT e.event_type, date_trunc('month', e.ts)::TIMESTAMP AS month, count(*) AS n_events
FROM events e GROUP BY ALL""")
def monthly_events(spark, sf):
    events = b.table(spark, sf, "events")
    return events.groupBy("event_type", times.month_of(F.col("ts")).alias("month")).agg(
        F.count(F.lit(1)).alias("n_events")
    )


def _raw_orders(spark, sf):
    """Orders with the headers of the ticket table; the opening date is text."""
    solved = (
        b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("solved"))
    )
    orders = b.table(spark, sf, "orders")
    return orders.join(solved, orders["o_orderkey"] == solved["l_orderkey"], "left").select(
        F.col("o_orderkey").alias(names.ID),
        F.col("o_orderdate").cast("string").alias(names.OPENED),
        F.col("solved").cast("string").alias(names.SOLVED),
        F.nullif("o_orderstatus", F.lit("P")).alias(names.UNIT),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias(names.STATE),
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias(names.TEAM),
        F.col("o_orderpriority").alias(names.PRIORITY),
        F.col("o_totalprice").alias("Total_Horas"),
        F.col("o_custkey").alias("cliente"),
    )


@query("""
WITH solved AS (SELECT l_orderkey, min(l_shipdate) AS solved FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS "Id", o_orderdate AS "Data de abertura", solved AS "Data de Solução",
  CAST(round_even(epoch_us(solved - o_orderdate) / 3.6e9, 1) AS DOUBLE) AS "Tempo em horas do atendimento",
  coalesce(nullif(o_orderstatus, 'P'), 'Não Informado') AS "Unidade",
  coalesce(nullif(o_orderpriority, '5-LOW'), 'Não Informado') AS "Estado",
  coalesce(nullif(o_orderpriority, '1-URGENT'), 'Não Atribuído') AS "Time",
  o_custkey AS cliente
FROM orders LEFT JOIN solved ON l_orderkey = o_orderkey""")
def resolution_hours(spark, sf):
    return prepare.prepare_metrics(_raw_orders(spark, sf))


@query("""
SELECT o_orderkey, o_orderdate AS good, TRY_CAST(o_orderpriority AS TIMESTAMP) AS bad,
  date_trunc('day', o_orderdate)::TIMESTAMP AS patterned
FROM orders""")
def lenient_timestamps(spark, sf):
    orders = b.table(spark, sf, "orders")
    brazilian = F.date_format("o_orderdate", "dd/MM/yyyy")
    return orders.select(
        "o_orderkey",
        times.parse_timestamp(F.col("o_orderdate").cast("string")).alias("good"),
        times.parse_timestamp(F.col("o_orderpriority")).alias("bad"),
        times.parse_timestamp(brazilian, "dd/MM/yyyy").alias("patterned"),
    )


@query(with_(ASSIGN, COUNTS) + "SELECT system, topic, n AS n_documents FROM counts")
def topic_counts(spark, sf):
    return counts.tickets_per_topic(b.assignments(spark, sf))


@query(with_(ASSIGN, SYSTEMS, SPINE, COUNTS) + """
SELECT system, topic, coalesce(n, 0) AS n_documents FROM spine LEFT JOIN counts USING (system, topic)""")
def topic_spine(spark, sf):
    return counts.counts_on_spine(b.spine(spark, sf), b.assignments(spark, sf))


_TABLE = """words AS (
  SELECT system, topic, string_agg(term, ', ' ORDER BY rank) AS keywords FROM terms
  WHERE rank <= 8 GROUP BY system, topic),
topic_table AS (
  SELECT system, topic, coalesce(titles.text, 'Tópico ' || topic) AS title,
    coalesce(n_name, '') AS pattern, coalesce(r_name, '') AS impact,
    coalesce(keywords, '') AS keywords, coalesce(n, 0) AS n_documents
  FROM spine LEFT JOIN counts USING (system, topic) LEFT JOIN titles USING (system, topic)
  LEFT JOIN words USING (system, topic) LEFT JOIN nation ON n_nationkey = topic
  LEFT JOIN region ON r_regionkey = n_regionkey)"""
_TABLE_SQL = with_(ASSIGN, SYSTEMS, SPINE, COUNTS, SUMMARY_TEXTS, TERMS, _TABLE)


def _plain_table(spark, sf):
    """Titles and counts only, for the views that show no words."""
    counted = counts.counts_on_spine(b.spine(spark, sf), b.assignments(spark, sf))
    titled = counted.join(_titles(spark, sf), ["system", "topic"], "left")
    return titled.withColumn("title", keys.default_title(F.col("title"), F.col("topic")))


_PLAIN = """plain AS (
  SELECT system, topic, coalesce(text, 'Tópico ' || topic) AS title, coalesce(n, 0) AS n_documents
  FROM spine LEFT JOIN counts USING (system, topic) LEFT JOIN titles USING (system, topic))"""
_PLAIN_SQL = with_(ASSIGN, SYSTEMS, SPINE, COUNTS, SUMMARY_TEXTS, _PLAIN)


@query(_PLAIN_SQL + "SELECT system, topic, title, n_documents FROM plain")
def topic_ranking(spark, sf):
    return counts.ranking(_plain_table(spark, sf))


@query(_TABLE_SQL + "SELECT system, topic, title, n_documents, pattern, impact FROM topic_table")
def topic_ranking_full(spark, sf):
    return counts.ranking(_topic_table(spark, sf), descending=True)


@query(_PLAIN_SQL + """
SELECT system, count(*) AS n_topics, CAST(sum(n_documents) AS BIGINT) AS n_documents,
  CAST(round_even(sum(n_documents) / count(*), 1) AS DOUBLE) AS mean_documents,
  arg_max(title, n_documents * 1000 - topic) AS largest_title,
  max(n_documents) AS largest_n
FROM plain GROUP BY system""")
def topic_kpis(spark, sf):
    return counts.indicators(_plain_table(spark, sf))


@query(_PLAIN_SQL + """
, roots AS (SELECT *, sqrt(greatest(n_documents, 1)) AS r FROM plain)
, ends AS (SELECT *, min(r) OVER (PARTITION BY system) AS lo, max(r) OVER (PARTITION BY system) AS hi FROM roots)
SELECT system, topic, n_documents,
  round(CASE WHEN hi > lo THEN 1 + (r - lo) / (hi - lo) * 9 ELSE 5 END, 6) AS size
FROM ends""")
def topic_scaling(spark, sf):
    scaled = counts.prevalence_scale(_plain_table(spark, sf))
    return scaled.select("system", "topic", "n_documents", F.round("size", 6).alias("size"))


@query(_PLAIN_SQL + """
, placed AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY topic) - 1 AS i,
    count(*) OVER (PARTITION BY system) AS n FROM plain)
SELECT system, topic, round(cos(2 * pi() * i / n), 6) + 0 AS x, round(sin(2 * pi() * i / n), 6) + 0 AS y
FROM placed""")
def topic_circle(spark, sf):
    placed = counts.circular_layout(_plain_table(spark, sf))
    at = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)
    return placed.select("system", "topic", at("x"), at("y"))


def _stored_coordinates(spark, sf):
    """Old coordinates of the English and French topics, one outlier topic each."""
    place = b.table(spark, sf, "nation").select(
        (F.col("n_nationkey") - 1).alias("topic"),
        F.col("n_regionkey").cast("double").alias("x"),
        F.col("n_nationkey").cast("double").alias("y"),
        F.lit(99).cast("bigint").alias("n_documents"),
    )
    systems = b.systems(spark, sf).where(F.col("system").isin("en", "fr")).select("system", "k")
    return place.join(systems, F.col("topic") < F.col("k")).drop("k")


_STORED = """stored AS (
  SELECT system, CAST(n_nationkey - 1 AS INTEGER) AS topic, CAST(n_regionkey AS DOUBLE) AS x,
    CAST(n_nationkey AS DOUBLE) AS y FROM nation JOIN systems ON n_nationkey - 1 < k
  WHERE system IN ('en', 'fr')),
refreshed AS (
  SELECT s.system, s.topic, x, y, coalesce(n, 99) AS n_documents
  FROM stored s LEFT JOIN counts c ON c.system = s.system AND c.topic = s.topic WHERE s.topic >= 0)"""


@query(with_(ASSIGN, SYSTEMS, COUNTS, _STORED) + "SELECT * FROM refreshed")
def refreshed_coordinates(spark, sf):
    fresh = counts.refreshed_counts(_stored_coordinates(spark, sf), b.assignments(spark, sf))
    return fresh.select("system", "topic", "x", "y", "n_documents")


@query(with_(ASSIGN, SYSTEMS, SPINE, COUNTS, SUMMARY_TEXTS, _PLAIN, _STORED) + """
, circle AS (
  SELECT system, topic, cos(2 * pi() * (row_number() OVER w - 1) / count(*) OVER (PARTITION BY system)) AS x,
    sin(2 * pi() * (row_number() OVER w - 1) / count(*) OVER (PARTITION BY system)) AS y, n_documents
  FROM plain WHERE system NOT IN (SELECT system FROM refreshed)
  WINDOW w AS (PARTITION BY system ORDER BY topic))
, points AS (SELECT * FROM refreshed UNION ALL SELECT * FROM circle)
, roots AS (SELECT *, sqrt(greatest(n_documents, 1)) AS r FROM points)
, ends AS (SELECT *, min(r) OVER (PARTITION BY system) AS lo, max(r) OVER (PARTITION BY system) AS hi FROM roots)
SELECT e.system, e.topic, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y, e.n_documents,
  coalesce(p.title, 'Tópico ' || e.topic) AS title,
  round(CASE WHEN hi > lo THEN 1 + (r - lo) / (hi - lo) * 9 ELSE 5 END, 6) AS size
FROM ends e LEFT JOIN plain p ON p.system = e.system AND p.topic = e.topic""")
def topic_map(spark, sf):
    coordinates = counts.refreshed_counts(_stored_coordinates(spark, sf), b.assignments(spark, sf))
    points = counts.map_points(_plain_table(spark, sf), coordinates)
    at = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)
    return points.select("system", "topic", at("x"), at("y"), "n_documents", "title", at("size"))


@query(with_(ASSIGN) + """
SELECT system, id, topic FROM assign
WHERE system IN (SELECT system FROM assign GROUP BY system HAVING count(*) >= 70)""")
def population_gate(spark, sf):
    return counts.large_enough(b.assignments(spark, sf), 70)


@query("""
SELECT source AS team, count(*) AS n_tickets FROM documents
WHERE source IS NOT NULL AND trim(source) <> '' GROUP BY source""")
def team_frequency(spark, sf):
    return counts.team_frequency(b.tickets(spark, sf))


@query("""
SELECT o_orderpriority AS team, count(*) AS n_tickets FROM orders
WHERE o_orderpriority IS NOT NULL AND trim(o_orderpriority) <> '' GROUP BY o_orderpriority""")
def team_frequency_orders(spark, sf):
    return counts.team_frequency(b.table(spark, sf, "orders"), "o_orderpriority")


# Ids, duplicates and tags


@query("""
SELECT doc_id AS position, CAST(doc_id AS VARCHAR) AS id FROM documents""")
def id_repair(spark, sf):
    raw = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("position"),
        F.concat(F.lit(" "), F.col("doc_id").cast("double").cast("decimal(20,1)").cast("string")).alias("id"),
    )
    return columns.with_clean_id(raw)


@query("""
SELECT id, position, role, text FROM (
  SELECT CAST(conv_id AS VARCHAR) AS id, turn AS position, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
WHERE r = 1""")
def ticket_dedup(spark, sf):
    turns = b.table(spark, sf, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(".0")).alias("id"),
        F.col("turn").alias("position"),
        "role",
        "text",
    )
    return tags.first_per_id(turns, "position")


@query("""
SELECT doc_id, text, lang FROM documents WHERE CAST(doc_id AS VARCHAR) = '17'
ORDER BY doc_id LIMIT 1""")
def ticket_by_id(spark, sf):
    documents = b.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return columns.ticket_by_id(documents, " 17 ", "doc_id", "doc_id")


def _two_level_assignments(spark, sf):
    """A ticket is in its own system and, by a coarser topic, in the one over all."""
    order = (
        F.when(F.col("system") == "en", 0)
        .when(F.col("system") == "fr", 1)
        .when(F.col("system") == "de", 2)
        .otherwise(3)
    )
    base = b.assigned(spark, sf).select("id", "system", "topic", "position")
    own = base.withColumn("system_order", order)
    over_all = base.select(
        "id",
        F.lit("TO TAIS").alias("system"),
        (F.col("topic") % 4).cast("int").alias("topic"),
        "position",
    ).withColumn("system_order", F.lit(9))
    return own.unionByName(over_all)


_TAGS = """tags AS (
  SELECT id, upper(system) || '_' || topic || ',TOTAIS_' || (topic % 4) AS topic_tags,
    system || ',TO TAIS' AS systems, topic, system FROM assign)"""


@query(with_(ASSIGN, _TAGS) + "SELECT id, topic_tags, systems FROM tags")
def ticket_tags(spark, sf):
    tagged = tags.first_seen_tags(_two_level_assignments(spark, sf))
    return tagged.select(
        "id",
        tags.tag_string(F.col("topic_uids")).alias("topic_tags"),
        tags.tag_string(F.col("systems")).alias("systems"),
    )


@query(with_(ASSIGN, _TAGS) + """
SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(systems, 'NAO_CLASSIFICADO') AS systems, topic_tags
FROM documents LEFT JOIN tags ON id = CAST(doc_id AS VARCHAR)""")
def tagged_tickets(spark, sf):
    tagged = tags.first_seen_tags(_two_level_assignments(spark, sf))
    joined = tags.tickets_with_tags(b.tickets(spark, sf).select("id"), tagged)
    return joined.select(
        "id",
        tags.tag_string(F.col("systems")).alias("systems"),
        tags.tag_string(F.col("topic_uids")).alias("topic_tags"),
    )


@query(with_(ASSIGN) + """
SELECT upper(system) || '_' || topic AS topic_uid, id FROM assign
UNION ALL SELECT 'TOTAIS_' || (topic % 4), id FROM assign""")
def inverted_index(spark, sf):
    tagged = tags.first_seen_tags(_two_level_assignments(spark, sf)).select(
        "id", tags.tag_string(F.col("topic_uids")).alias("topic_tags")
    )
    return tags.postings(
        tagged.select("id", tags.tag_list(F.col("topic_tags")).alias("topic_uids"))
    )


_VALID = """known AS (SELECT system || '_' || topic AS topic_uid FROM (
    SELECT DISTINCT upper(system) AS system, topic FROM assign WHERE topic < 3)),
marked AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    coalesce(upper(system) || '_' || topic IN (SELECT topic_uid FROM known), false) AS valid
  FROM documents LEFT JOIN tags ON id = CAST(doc_id AS VARCHAR))"""


def _marked(spark, sf):
    tagged = tags.first_seen_tags(_two_level_assignments(spark, sf))
    joined = tags.tickets_with_tags(b.tickets(spark, sf).select("id"), tagged)
    strings = joined.select("id", tags.tag_string(F.col("topic_uids")).alias("topic_tags"))
    known = b.assignments(spark, sf).where("topic < 3").select(
        keys.topic_uid(F.col("system"), F.col("topic")).alias("topic_uid")
    )
    return tags.with_valid_tag(strings, known.distinct())


@query(with_(ASSIGN, _TAGS, _VALID) + "SELECT id, valid FROM marked")
def tag_validity(spark, sf):
    return _marked(spark, sf).select("id", "valid")


@query(with_(ASSIGN, _TAGS, _VALID) + """
SELECT count(*) FILTER (valid) AS mapped, count(*) AS total FROM marked""")
def mapped_tickets(spark, sf):
    return tags.mapped_counts(_marked(spark, sf))


# Consolidated tables


def _topic_table(spark, sf):
    from ticketloom.operators import terms

    documents = b.assigned(spark, sf, text_work=True).select("system", "topic", "text")
    top = terms.topic_terms(terms.term_weights(documents))
    return topic_tables.topic_table(
        b.systems(spark, sf),
        b.assignments(spark, sf),
        top,
        b.summaries(spark, sf),
        b.titles(spark, sf),
    )


@query(_TABLE_SQL + "SELECT * FROM topic_table")
def topic_table(spark, sf):
    return _topic_table(spark, sf)


@query(_PLAIN_SQL + """
SELECT system, topic, coalesce(t.text, '') AS title, p.n_documents,
  coalesce(n_name, '') AS pattern, coalesce(r_name, '') AS impact, '' AS notes
FROM plain p LEFT JOIN titles t USING (system, topic)
LEFT JOIN nation ON n_nationkey = topic LEFT JOIN region ON r_regionkey = n_regionkey""")
def review_table(spark, sf):
    return topic_tables.review_table(
        b.systems(spark, sf),
        b.assignments(spark, sf),
        b.summaries(spark, sf),
        b.titles(spark, sf),
    )


_RECOMMENDER_TOPICS = """
SELECT upper(system) || '_' || topic AS topico_id_unico, system AS sistema_origem,
  topic AS topico_id_original, title AS label_curto,
  trim(regexp_replace('Padrão Dominante: ' || pattern || ' Impacto Operacional: ' || impact, '\\s+', ' ', 'g'))
    AS resumo_sumarizado,
  n_documents AS n_documentos, keywords, pattern AS padrao_dominante, impact AS impacto_operacional,
  trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS texto_para_embedding
FROM topic_table"""


@query(_TABLE_SQL + _RECOMMENDER_TOPICS.format(text="title || '. ' || pattern || ' ' || impact"))
def recommender_topics(spark, sf):
    return topic_tables.recommender_topics(_topic_table(spark, sf))


@query(_TABLE_SQL + _RECOMMENDER_TOPICS.format(
    text="title || '. ' || pattern || ' ' || impact || ' ' || keywords"))
def recommender_topics_keywords(spark, sf):
    return topic_tables.recommender_topics(_topic_table(spark, sf), with_keywords=True)


_SOLVED = "solved AS (SELECT l_orderkey, min(l_shipdate) AS solved FROM lineitem GROUP BY l_orderkey)"


@query(with_(ASSIGN, _TAGS, _SOLVED) + r"""
SELECT CAST(doc_id AS VARCHAR) AS "Id", coalesce(systems, 'NAO_CLASSIFICADO') AS sistema_origem,
  topic_tags AS topico_id_unico, p_name AS "Título", documents.text AS "Descrição do chamado",
  'ver ' || url || ' fim' AS "Última ação de acompanhamento", source AS "Time",
  c_mktsegment AS "Categoria", o_orderstatus AS "Status", o_orderpriority AS "Prioridade",
  o_orderdate AS "Data de abertura", solved AS "Data de Solução",
  concat_ws(' | ', 'Título: ' || nullif(trim(regexp_replace(p_name, '\s+', ' ', 'g')), ''),
    'Descrição: ' || nullif(trim(regexp_replace(documents.text, '[\s\x0b]+', ' ', 'g')), '')) AS texto_completo,
  nullif(regexp_extract('ver ' || url || ' fim', 'https?://[^\s<>"]+|www\.[^\s<>"]+'), '') AS link_solucao,
  n_chars AS extra
FROM documents LEFT JOIN tags ON id = CAST(doc_id AS VARCHAR)
LEFT JOIN part ON p_partkey = doc_id LEFT JOIN customer ON c_custkey = doc_id
LEFT JOIN orders ON o_orderkey = doc_id LEFT JOIN solved ON l_orderkey = doc_id
LEFT JOIN pages ON page_id = doc_id""")
def recommender_tickets(spark, sf):
    return topic_tables.recommender_tickets(
        b.raw_tickets(spark, sf), _two_level_assignments(spark, sf), "position"
    )


# Columns and text assembly


@query("""
SELECT CAST(doc_id AS VARCHAR) AS id, text AS "Descrição do chamado_y", lang AS idioma
FROM documents WHERE text IS NOT NULL""")
def described_tickets(spark, sf):
    raw = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("Descrição do chamado_y"),
        F.col("lang").alias("idioma"),
    )
    return prepare.with_text(raw, columns.description_column(raw.columns))


@query(r"""
SELECT doc_id, concat_ws(' | ', 'Título: ' || nullif(trim(regexp_replace(p_name, '\s+', ' ', 'g')), ''),
  'Descrição: ' || nullif(trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')), '')) AS full_text
FROM documents LEFT JOIN part ON p_partkey = doc_id""")
def ticket_full_text(spark, sf):
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    documents = b.table(spark, sf, "documents").select("doc_id", "text")
    return documents.join(part, "doc_id", "left").select(
        "doc_id", text.full_text(F.col("p_name"), F.col("text")).alias("full_text")
    )


@query(r"""
SELECT page_id,
  nullif(regexp_extract('ver ' || url || ' fim', 'https?://[^\s<>"]+|www\.[^\s<>"]+'), '') AS link,
  nullif(regexp_extract(html, 'https?://[^\s<>"]+|www\.[^\s<>"]+'), '') AS html_link
FROM pages""")
def first_url(spark, sf):
    line = F.concat(F.lit("ver "), "url", F.lit(" fim"))
    return b.table(spark, sf, "pages").select(
        "page_id", text.first_url(line).alias("link"), text.first_url(F.col("html")).alias("html_link")
    )


@query("""
SELECT doc_id,
  CASE WHEN length(text) > 180 THEN substr(replace(text, chr(10), ' '), 1, 177) || '...'
       ELSE replace(text, chr(10), ' ') END AS preview,
  CASE WHEN a IS NULL THEN 'Sem última ação de acompanhamento documentada.'
       WHEN length(a) > 100 THEN substr(a, 1, 100) || '...' ELSE a END AS action
FROM documents LEFT JOIN (
  SELECT conv_id, text AS a FROM conversations WHERE turn = 1) c ON conv_id = doc_id""")
def preview(spark, sf):
    answers = b.table(spark, sf, "conversations").where("turn = 1").select(
        F.col("conv_id").alias("doc_id"), F.col("text").alias("a")
    )
    documents = b.table(spark, sf, "documents").select("doc_id", "text")
    return documents.join(answers, "doc_id", "left").select(
        "doc_id",
        text.preview(F.col("text")).alias("preview"),
        text.action_preview(F.col("a")).alias("action"),
    )


# A tenth of the tickets of the first two batches moves to the next topic with the third.
@query(with_(ASSIGN, """dated AS (
  SELECT system, CASE WHEN position % 3 < 2 AND position % 10 = 0 THEN (topic + 1) % 10 ELSE topic END AS topic,
    o_orderdate AS opened
  FROM assign JOIN orders ON o_orderkey = position WHERE o_orderdate IS NOT NULL)""", SYSTEMS, SPINE, SUMMARY_TEXTS, _MONTHLY) + """
SELECT m.system, m.month, m.topic, coalesce(t.text, 'Tópico ' || m.topic) AS title, m.n_tickets
FROM monthly m LEFT JOIN titles t ON m.system = t.system AND m.topic = t.topic""")
def monthly_running(spark, sf):
    """The monthly series from three batches, one sent twice, and moved tickets: equal to one pass."""
    folder = shared_folder(spark)
    rows = _dated(spark, sf).withColumn("position", F.col("id").cast("long"))
    batch = lambda i: rows.where(F.col("position") % 3 == i)
    moved = rows.where((F.col("position") % 3 < 2) & (F.col("position") % 10 == 0))
    placed = moved.withColumn("topic", (F.col("topic") + 1) % 10)
    running_counts.add_batch(folder, "first", batch(0))
    running_counts.add_batch(folder, "second", batch(1))
    running_counts.add_batch(folder, "first", batch(0))
    running_counts.add_batch(folder, "third", batch(2).unionByName(placed), moved)
    return running_counts.evolution(running_counts.current(spark, folder), _titles(spark, sf))


@query("""
SELECT CAST(d.doc_id AS VARCHAR) AS id, source AS team, '' AS action, source AS category, quality
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def missing_columns(spark, sf):
    """Columns a table lacks: a constant, a copy of another one, and a table that lacks one it must have.

    The last is read as empty with its columns, so every ticket stays and nothing is looked up.
    """
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("team"))
    full = columns.add_if_missing(docs, "action", F.lit(""))
    full = columns.copy_if_missing(columns.add_if_missing(full, "team", F.lit("x")), "category", "team")
    labels = b.table(spark, sf, "labels").withColumn("id", F.col("doc_id").cast("string"))
    needed = {"id": T.StringType(), "quality": T.IntegerType()}
    whole = columns.require_or_empty(labels.select("id", "quality"), needed)
    none = columns.require_or_empty(labels.select("id", F.col("quality").alias("other")), needed)
    return full.join(whole.unionByName(none), "id", "left")
