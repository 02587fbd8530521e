"""Two-level search and recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.functions import vectors
from ticketloom.operators import nearest, search, sparse, terms
from ticketloom.operators.scale import salted_join
from ticketloom.registry import bindings as b
from ticketloom.plans import text_search as by_text
from ticketloom.registry.core import ASSIGN, CENTROIDS, TERMS, query, with_

_TOPICS = """topics AS (
  SELECT upper(system) || '_' || topic AS topic_uid, system,
    list_transform(centroid, lambda x: x / sqrt(list_dot_product(centroid, centroid))) AS tv
  FROM centroids)"""
_QUERIES = """queries AS (
  SELECT CAST(vec_id AS VARCHAR) AS query_id, CAST(embedding AS DOUBLE[]) AS qv,
    CASE label % 3 WHEN 1 THEN 'EN' WHEN 2 THEN 'TOTAIS' END AS system_filter,
    CASE label % 2 WHEN 1 THEN 'SRC1' END AS team_filter
  FROM embeddings)"""
_RANKED = """ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(topic_score, 6) DESC, topic_uid) AS rank
  FROM (SELECT query_id, topic_uid, system, list_dot_product(qv, tv) AS topic_score
        FROM queries, topics))"""


def _relevant(k: int, filters: bool) -> str:
    if not filters:
        return f"relevant AS (SELECT * FROM ranked WHERE rank <= {k})"
    return f"""relevant AS (
  SELECT query_id, topic_uid, system, topic_score, place AS rank FROM (
    SELECT r.*, row_number() OVER (PARTITION BY r.query_id ORDER BY rank) AS place
    FROM ranked r JOIN queries q USING (query_id)
    WHERE CASE WHEN system_filter = 'EN' THEN rank <= {30 * k} AND upper(system) = 'EN' ELSE rank <= {k} END)
  WHERE place <= {k})"""


def _chosen(floor: float, generic: str = "Geral") -> str:
    return f"""best AS (
  SELECT query_id, max(topic_score) FILTER (system <> '{generic}') AS best
  FROM relevant WHERE topic_score >= {floor} GROUP BY query_id),
chosen AS (
  SELECT r.* FROM relevant r JOIN best USING (query_id) JOIN queries q USING (query_id)
  WHERE topic_score >= {floor} AND (coalesce(system_filter, '') = 'EN' AND {{filters}}
    OR system <> '{generic}' OR best IS NULL OR topic_score > best + 0.10))"""


_TICKETS = """tagged AS (
  SELECT id, team, embedding, unnest([upper(system) || '_' || topic,
    CASE WHEN system = 'en' THEN 'FR' ELSE 'EN' END || '_' || topic]) AS topic_uid FROM assign)"""
_HITS = """pairs AS (SELECT DISTINCT query_id, id FROM chosen JOIN tagged USING (topic_uid)),
scored AS (
  SELECT query_id, id, team, list_dot_product(qv, embedding) AS score
  FROM pairs JOIN queries USING (query_id) JOIN assign USING (id)),
hits AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM scored)"""


def _search_sql(k_topics: int, floor: float, filters: bool = False, generic: str = "Geral") -> str:
    chosen = _chosen(floor, generic).format(filters="true" if filters else "false")
    return with_(
        ASSIGN, CENTROIDS, _TOPICS, _QUERIES, _RANKED, _relevant(k_topics, filters), chosen, _TICKETS, _HITS
    )


_SIMILAR = """, fitting AS (
  SELECT query_id, id, team, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank
  FROM hits JOIN queries USING (query_id)
  WHERE score >= 0.20 AND rank <= CASE WHEN team_filter IS NULL THEN {k} ELSE 3 * {k} END
    AND (team_filter IS NULL OR contains(upper(team), upper(team_filter)))),
kept AS (SELECT * FROM fitting WHERE rank <= {k})"""


def _shown(found, score: str = "score"):
    """Scores as they are reported; all rules have been applied to the whole ones."""
    return found.withColumn(score, F.round(score, 6) + F.lit(0.0))


def _plain_similar(k: int) -> str:
    return f", kept AS (SELECT * FROM hits WHERE score >= 0.20 AND rank <= {k})"


@query(_search_sql(5, 0.2) + """
SELECT query_id, topic_uid, system, round(topic_score, 6) + 0 AS topic_score, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 5""")
def topk_topics(spark, sf):
    return _shown(search.rank_topics(b.search_queries(spark, sf), b.search_topics(spark, sf), 5), "topic_score")


@query(_search_sql(5, 0.2, filters=True) + """
SELECT query_id, topic_uid, system, round(topic_score, 6) + 0 AS topic_score, CAST(rank AS INTEGER) AS rank
FROM relevant""")
def topk_topics_filtered(spark, sf):
    found = search.relevant_topics(b.search_queries(spark, sf, filters=True), b.search_topics(spark, sf), 5)
    return _shown(found, "topic_score").withColumn("rank", F.col("rank").cast("int"))


@query(_search_sql(5, 0.1, generic="fr") + "SELECT query_id, topic_uid, system, round(topic_score, 6) + 0 AS topic_score FROM chosen")
def specific_topics_first(spark, sf):
    chosen = search.chosen_topics(
        b.search_queries(spark, sf), b.search_topics(spark, sf), 5, 0.1, generic_system="fr"
    )
    return _shown(chosen.select("query_id", "topic_uid", "system", "topic_score"), "topic_score")


# Every ticket against every ticket, no topics in between.
@query(with_(ASSIGN, _QUERIES) + """
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT query_id, id, round(list_dot_product(qv, embedding), 6) AS score FROM queries, assign))
WHERE rank <= 10""")
def topk_tickets(spark, sf):
    tickets = b.assigned(spark, sf).select("id", "embedding")
    return _shown(nearest.top_matches(b.search_queries(spark, sf), tickets, 10, item_id="id"))


# Tickets of the three large systems are listed once more, as in an over-all base, with half their vector.
@query(with_(ASSIGN, _QUERIES) + """
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT query_id, id, max(score) AS score FROM (
      SELECT query_id, id, round(list_dot_product(qv, embedding), 6) AS score FROM queries, assign
      UNION ALL
      SELECT query_id, id, round(list_dot_product(qv, embedding) * 0.5, 6) FROM queries, assign
      WHERE system IN ('en', 'es', 'fr'))
    GROUP BY query_id, id))
WHERE rank <= 10""")
def topk_repeated_tickets(spark, sf):
    listed = b.assigned(spark, sf).select("system", "id", F.col("embedding").cast("array<double>").alias("embedding"))
    again = listed.where(F.col("system").isin("en", "es", "fr")).withColumn(
        "embedding", F.transform("embedding", lambda x: x * 0.5)
    )
    return _shown(nearest.top_matches(b.search_queries(spark, sf), listed.unionByName(again).drop("system"), 10, item_id="id"))


@query(_search_sql(3, 0.3) + """
, first AS (SELECT query_id, arg_min(system, rank) AS detected FROM chosen GROUP BY query_id)
SELECT q.query_id, detected AS detected_system, coalesce(n, 0) AS n_candidates
FROM queries q LEFT JOIN first USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS n FROM pairs GROUP BY query_id) USING (query_id)""")
def candidate_counts(spark, sf):
    queries, topics = b.search_queries(spark, sf), b.search_topics(spark, sf)
    chosen = search.chosen_topics(queries, topics)
    return search.detected_system(queries, chosen, b.search_tickets(spark, sf))


@query(_search_sql(3, 0.3) + """
SELECT query_id, id, round(score, 6) + 0 AS score, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 5""")
def hierarchical_search(spark, sf):
    return _shown(
        search.hierarchical_search(
            b.search_queries(spark, sf), b.search_topics(spark, sf), b.search_tickets(spark, sf)
        )
    )


@query(_search_sql(5, 0.2, filters=True) + _SIMILAR.format(k=10) + "SELECT query_id, rank, id, round(score, 6) + 0 AS score, team FROM kept")
def similar_tickets(spark, sf):
    return _shown(
        search.similar_tickets(
            b.search_queries(spark, sf, filters=True),
            b.search_topics(spark, sf),
            b.search_tickets(spark, sf),
            details=b.search_details(spark, sf),
        )
    )


@query(_search_sql(5, 0.2) + _plain_similar(10) + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) + 0 AS score, team FROM kept
WHERE query_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""")
def more_like_id(spark, sf):
    tickets = b.search_tickets(spark, sf)
    ids = b.table(spark, sf, "labels").select(
        F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("id")
    )
    found = search.similar_tickets(
        search.tickets_as_queries(ids, tickets),
        b.search_topics(spark, sf),
        tickets,
        details=b.search_details(spark, sf),
    )
    return _shown(found)


_PATTERN = """, solved AS (SELECT l_orderkey, min(l_shipdate) AS solved FROM lineitem GROUP BY l_orderkey),
found AS (
  SELECT k.*, coalesce(c_mktsegment, 'N/A') AS category,
    round_even(epoch_us(solved - o_orderdate) / 3.6e9, 1) AS hours
  FROM kept k LEFT JOIN customer ON c_custkey = CAST(id AS BIGINT)
  LEFT JOIN orders ON o_orderkey = CAST(id AS BIGINT) LEFT JOIN solved ON l_orderkey = o_orderkey),
figures AS (
  SELECT query_id, count(*) AS n_tickets, round(coalesce(avg(hours) FILTER (hours > 0), 0), 6) AS mean_hours,
    round(avg(score), 9) AS mean_score, round(max(score), 6) AS best_score, max(score) AS whole_best,
    string_agg(id, ',' ORDER BY rank) AS tickets
  FROM found GROUP BY query_id),
team_mode AS (
  SELECT query_id, team AS modal_team, n AS modal_team_n FROM (
    SELECT query_id, team, count(*) AS n,
      row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, team) AS r
    FROM found GROUP BY query_id, team) WHERE r = 1),
category_mode AS (
  SELECT query_id, category AS modal_category FROM (
    SELECT query_id, category,
      row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, category) AS r
    FROM found GROUP BY query_id, category) WHERE r = 1)"""


def _rounded(answers):
    """Means as they are reported."""
    return answers.withColumns(
        {"mean_hours": F.round("mean_hours", 6), "mean_score": F.round("mean_score", 9)}
    )


@query(_search_sql(5, 0.2) + _plain_similar(10) + _PATTERN + """
SELECT query_id, n_tickets, mean_hours, mean_score, modal_team, modal_team_n, modal_category,
  modal_team_n >= n_tickets * 0.6 AS concentrated
FROM figures JOIN team_mode USING (query_id) JOIN category_mode USING (query_id)""")
def result_pattern(spark, sf):
    results = search.similar_tickets(
        b.search_queries(spark, sf),
        b.search_topics(spark, sf),
        b.search_tickets(spark, sf),
        attributes=("team", "category", "hours"),
        details=b.search_details(spark, sf),
    )
    pattern = search.result_pattern(results)
    return _rounded(pattern)


@query(_search_sql(5, 0.2, filters=True) + _SIMILAR.format(k=3) + _PATTERN + """
SELECT q.query_id,
  CASE WHEN best_score IS NULL THEN 'Nenhuma' WHEN whole_best >= 0.70 THEN 'Alta'
       WHEN whole_best >= 0.50 THEN 'Média' ELSE 'Baixa' END AS confidence,
  coalesce(best_score, 0) AS best_score, coalesce(tickets, '') AS tickets,
  modal_team, modal_team_n, coalesce(n_tickets, 0) AS n_tickets, modal_category, mean_hours, mean_score,
  modal_team_n >= n_tickets * 0.6 AS concentrated
FROM queries q LEFT JOIN figures USING (query_id) LEFT JOIN team_mode USING (query_id)
LEFT JOIN category_mode USING (query_id)""")
def recommend(spark, sf):
    answers = search.recommend(
        b.search_queries(spark, sf, filters=True),
        b.search_topics(spark, sf),
        b.search_tickets(spark, sf),
        details=b.search_details(spark, sf),
    )
    return _shown(_rounded(answers), "best_score").withColumn("tickets", F.array_join("tickets", ","))


@query(with_(ASSIGN, CENTROIDS) + """
SELECT system, id, topic, round(list_dot_product(embedding, centroid), 6) + 0 AS product
FROM assign JOIN centroids USING (system, topic)""")
def inner_products(spark, sf):
    from ticketloom.operators import clusters

    rows = b.assigned(spark, sf).select("system", "id", "topic", "embedding")
    centroids = clusters.topic_centroids(rows)
    product = vectors.dot(F.col("embedding"), F.col("centroid"))
    # A topic may hold a third of all tickets: such topics are cut into slices.
    both = salted_join(rows, centroids, ["system", "topic"], "n_documents", ["id"])
    return both.select("system", "id", "topic", (F.round(product, 6) + F.lit(0.0)).alias("product"))


@query()
def search_cells_read(spark, sf):
    """Pairs of query and cell that a search for every ticket reads, and how many there are."""
    rows = b.assigned(spark, sf).select("id", "embedding")
    return nearest.cells_read(b.search_queries(spark, sf), rows, 10, item_id="id")


# Questions in words: every user turn asks, tickets are the documents with a topic, and the
# text of a topic is its keywords, as its title and summary would be.
_ASKED = """asked AS (
  SELECT conv_id || ':' || turn AS query_id, text,
    CASE conv_id % 3 WHEN 1 THEN 'EN' WHEN 2 THEN 'TOTAIS' END AS system_filter,
    CASE conv_id % 2 WHEN 1 THEN 'SRC1' END AS team_filter
  FROM conversations WHERE role = 'user')"""
_LIKE = """asked AS (
  SELECT id AS query_id, coalesce(p_name, '') || ' ' || coalesce(text, '') AS text
  FROM assign LEFT JOIN part ON p_partkey = position
  WHERE position IN (SELECT doc_id FROM labels) AND position % 20 = 0)"""
TEXT_TOPIC_FLOOR, TEXT_FLOOR = 0.02, 0.05


def _slots(name: str, key: str, source: str) -> str:
    return rf"""{name}_tf AS (
  SELECT key, slot, count(*) AS tf FROM (
    SELECT {key} AS key, unnest(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
      lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {sparse.FEATURES})) AS slot FROM {source})
  GROUP BY key, slot)"""


def _vector(name: str) -> str:
    return f"""{name}_vec AS (
  SELECT key, slot, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM (
    SELECT key, slot, tf * coalesce(idf, (SELECT ln(count(*) + 1) FROM assign)) AS w
    FROM {name}_tf LEFT JOIN idf USING (slot)) WHERE w > 0)"""


def _text_sql(asked: str, k_topics: int, filters: bool) -> str:
    chosen = _chosen(TEXT_TOPIC_FLOOR).format(filters="true" if filters else "false")
    queries = "queries AS (SELECT query_id, {f} AS system_filter, {t} AS team_filter FROM asked)".format(
        f="system_filter" if filters else "NULL::VARCHAR", t="team_filter" if filters else "NULL::VARCHAR"
    )
    return with_(
        ASSIGN, TERMS, asked, queries,
        """topic_text AS (
  SELECT upper(system) || '_' || topic AS topic_uid, system, string_agg(term, ' ' ORDER BY rank) AS text
  FROM terms GROUP BY system, topic)""",
        _slots("ticket", "id", "assign"), _slots("topic", "topic_uid", "topic_text"), _slots("question", "query_id", "asked"),
        """idf AS (SELECT slot, ln(((SELECT count(*) FROM assign) + 1) / (count(*) + 1)) AS idf FROM ticket_tf GROUP BY slot)""",
        _vector("ticket"), _vector("topic"), _vector("question"),
        """ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(topic_score, 6) DESC, topic_uid) AS rank
  FROM (SELECT q.query_id, t.topic_uid, t.system, coalesce(s.score, 0) AS topic_score
        FROM queries q CROSS JOIN topic_text t LEFT JOIN (
          SELECT q.key AS query_id, t.key AS topic_uid, sum(q.w * t.w) AS score
          FROM question_vec q JOIN topic_vec t USING (slot) GROUP BY q.key, t.key) s USING (query_id, topic_uid)))""",
        _relevant(k_topics, filters), chosen, _TICKETS,
        """pairs AS (SELECT DISTINCT query_id, id FROM chosen JOIN tagged USING (topic_uid)),
products AS (
  SELECT q.key AS query_id, t.key AS id, sum(q.w * t.w) AS score
  FROM question_vec q JOIN ticket_vec t USING (slot) GROUP BY q.key, t.key),
scored AS (
  SELECT query_id, id, team, coalesce(score, 0) AS score
  FROM pairs LEFT JOIN products USING (query_id, id) JOIN assign USING (id)),
hits AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM scored)""",
    )


def _text_index(spark, sf):
    rows = b.assigned(spark, sf, text_work=True)
    words = terms.first_keywords(terms.topic_terms(terms.term_weights(rows.select("system", "topic", "text"))), None)
    uid = F.concat(F.upper("system"), F.lit("_"), F.col("topic").cast("string"))
    topics = words.select(uid.alias("topic_uid"), "system", F.array_join("terms", " ").alias("text"))
    tickets = b.search_tickets(spark, sf).drop("embedding").join(rows.select("id", "text"), "id")
    return by_text.build(topics, tickets)


def _questions(spark, sf, filters=False):
    turns = b.table(spark, sf, "conversations").where("role = 'user'")
    rows = turns.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "text", "conv_id"
    )
    if not filters:
        return rows.drop("conv_id")
    system = F.when(F.col("conv_id") % 3 == 1, F.lit("EN")).when(F.col("conv_id") % 3 == 2, F.lit("TOTAIS"))
    team = F.when(F.col("conv_id") % 2 == 1, F.lit("SRC1"))
    return rows.select("query_id", "text", system.alias("system_filter"), team.alias("team_filter"))


_TEXT_SIMILAR = _SIMILAR.replace("0.20", str(TEXT_FLOOR))
_FLOORS = {"floor": TEXT_FLOOR, "topic_floor": TEXT_TOPIC_FLOOR}


@query(_text_sql(_ASKED, 3, False) + """
SELECT query_id, id, round(score, 6) + 0 AS score, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 5""")
def text_search(spark, sf):
    """Every user turn as a typed question."""
    found = by_text.text_search(_text_index(spark, sf), _questions(spark, sf), topic_floor=TEXT_TOPIC_FLOOR)
    return _shown(found)


@query(_text_sql(_ASKED, 5, True) + _TEXT_SIMILAR.format(k=10) + """
SELECT query_id, rank, id, round(score, 6) + 0 AS score, team FROM kept""")
def text_similar(spark, sf):
    """The same with system and team filters and both floors."""
    index, details = _text_index(spark, sf), b.search_details(spark, sf)
    return _shown(by_text.text_similar(index, _questions(spark, sf, filters=True), details, **_FLOORS))


@query(_text_sql(_LIKE, 5, False) + _plain_similar(10).replace("0.20", str(TEXT_FLOOR)) + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) + 0 AS score, team FROM kept""")
def text_like_id(spark, sf):
    """Tickets like those with a label and an id divisible by 20, by title and description."""
    rows = b.tickets(spark, sf)
    titles = b.table(spark, sf, "part").select(F.col("p_partkey").alias("position"), F.col("p_name").alias("title"))
    texts = rows.join(titles, "position", "left").select("id", "title", F.col("text").alias("description"))
    asked = b.table(spark, sf, "labels").where("doc_id % 20 = 0").join(
        b.labels(spark, sf).select(F.col("id").cast("long").alias("doc_id")), "doc_id", "left_semi"
    )
    ids = asked.select(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(".0")).alias("id"))
    return _shown(by_text.text_like_id(_text_index(spark, sf), ids, texts, b.search_details(spark, sf), **_FLOORS))


@query(_text_sql(_ASKED, 5, True) + _TEXT_SIMILAR.format(k=3) + _PATTERN + """
SELECT q.query_id,
  CASE WHEN whole_best IS NULL THEN 'Nenhuma' WHEN whole_best >= 0.70 THEN 'Alta'
       WHEN whole_best >= 0.50 THEN 'Média' ELSE 'Baixa' END AS confidence,
  coalesce(best_score, 0) AS best_score, coalesce(tickets, '') AS tickets,
  modal_team, modal_team_n, coalesce(n_tickets, 0) AS n_tickets, modal_category, mean_hours, mean_score,
  modal_team_n >= n_tickets * 0.6 AS concentrated
FROM queries q LEFT JOIN figures USING (query_id) LEFT JOIN team_mode USING (query_id)
LEFT JOIN category_mode USING (query_id)""")
def text_recommend(spark, sf):
    """A recommendation for every user turn."""
    index, details = _text_index(spark, sf), b.search_details(spark, sf)
    answers = by_text.text_recommend(index, _questions(spark, sf, filters=True), details, **_FLOORS)
    return _shown(_rounded(answers), "best_score").withColumn("tickets", F.array_join("tickets", ","))
