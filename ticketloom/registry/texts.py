"""Cleaning, terms, distribution, ticket selection and model batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.functions import text, vectors, wordlists
from ticketloom.operators import cleaning, clusters, distribution, selection, terms
from ticketloom.operators.counts import topic_spine
from ticketloom.operators.scale import one_row_each, spread, stored
from ticketloom.plans import prepare, summaries
from ticketloom.registry import bindings as b
from ticketloom.registry.core import (
    ASSIGN,
    CENTROIDS,
    COUNTS,
    SPINE,
    SUMMARY_TEXTS,
    SYSTEMS,
    TERMS,
    query,
    with_,
)


def _sql_list(items) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(items))


_STOPS = _sql_list(text.stopwords())


def _fold(column: str) -> str:
    """Lower case without accents, other signs dropped."""
    plain = f"strip_accents(lower({column}))"
    for sign, letters in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o")):
        plain = f"replace({plain}, '{sign}', '{letters}')"
    return f"regexp_replace({plain}, '[^\\x00-\\x7F]', '', 'g')"


def _tokens(column: str) -> str:
    scrubbed = _fold(column)
    for greeting in wordlists.GREETINGS:
        scrubbed = f"replace({scrubbed}, '{greeting}', ' ')"
    scrubbed = f"regexp_replace({scrubbed}, '\\S+@\\S+', ' ', 'g')"
    scrubbed = f"regexp_replace({scrubbed}, 'http\\S+|www\\S+', ' ', 'g')"
    scrubbed = f"regexp_replace({scrubbed}, '[^\\w\\s]', ' ', 'g')"
    return f"regexp_split_to_array(trim(regexp_replace({scrubbed}, '\\s+', ' ', 'g')), ' ')"


_RULES = (
    "NOT starts_with(t, 'prezad') AND NOT starts_with(t, 'servidor') AND length(t) > 2 "
    "AND NOT regexp_matches(t, '^x+$') AND NOT regexp_matches(t, '[0-9]')"
)
_NAMES = f"""names AS (
  SELECT DISTINCT name FROM (
    SELECT trim({_fold("name")}) AS name FROM (
      SELECT DISTINCT unnest(regexp_split_to_array(text, '\\P{{L}}+')) AS name FROM benchmark))
  WHERE name <> 'nao' AND length(name) > 2)"""


def _cleaned(column: str, anonymous: bool) -> str:
    rules = f"{_RULES} AND t NOT IN ({_STOPS})"
    if anonymous:
        rules += " AND NOT list_contains((SELECT list(name) FROM names), t)"
    return f"array_to_string(list_filter({_tokens(column)}, lambda t: {rules}), ' ')"


@query(f"SELECT doc_id, coalesce({_cleaned('text', False)}, '') AS clean FROM documents")
def clean_text(spark, sf):
    documents = spread(b.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return cleaning.clean_column(documents, "text", id_col="doc_id", output="clean").drop("text")


# The twin joins exploded tokens, the library probes a set inside the row.
@query(f"""
WITH {_NAMES},
tokens AS (SELECT doc_id, unnest({_tokens("text")}) AS t,
    generate_subscripts({_tokens("text")}, 1) AS p FROM documents),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS clean FROM tokens
  WHERE {_RULES} AND t NOT IN ({_STOPS}) AND t NOT IN (SELECT name FROM names) GROUP BY doc_id)
SELECT doc_id, coalesce(clean, '') AS clean FROM documents LEFT JOIN kept USING (doc_id)""")
def clean_text_anonymised(spark, sf):
    documents = spread(b.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    deny = cleaning.name_list(b.name_words(spark, sf))
    return cleaning.clean_column(documents, "text", deny, id_col="doc_id", output="clean").drop("text")


# The same texts by the join that a list of any length takes.
@query(f"""
WITH {_NAMES},
tokens AS (SELECT doc_id, unnest({_tokens("text")}) AS t,
    generate_subscripts({_tokens("text")}, 1) AS p FROM documents),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS clean FROM tokens
  WHERE {_RULES} AND t NOT IN ({_STOPS}) AND t NOT IN (SELECT name FROM names) GROUP BY doc_id)
SELECT doc_id, coalesce(clean, '') AS clean FROM documents LEFT JOIN kept USING (doc_id)""")
def clean_text_joined(spark, sf):
    documents = spread(b.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    deny = cleaning.name_list(b.name_words(spark, sf))
    cleaned = cleaning.clean_column(documents, "text", deny, id_col="doc_id", output="clean", max_in_set=0)
    return cleaned.drop("text")


# Two lists that overlap: the words of even and of odd benchmark passages and of user turns.
_TWO_LISTS = f"""
SELECT DISTINCT name FROM (
  SELECT trim({_fold("name")}) AS name FROM (
    SELECT unnest(regexp_split_to_array(text, '\\P{{L}}+')) AS name FROM benchmark WHERE item_id % 2 = 0
    UNION ALL
    SELECT unnest(regexp_split_to_array(text, '\\P{{L}}+')) FROM conversations WHERE role = 'user'))
WHERE name <> 'nao' AND length(name) > 2"""


@query(_TWO_LISTS)
def deny_list(spark, sf):
    split = F.explode(F.split("text", r"\P{L}+")).alias("name")
    first = b.table(spark, sf, "benchmark").where("item_id % 2 = 0").select(split)
    second = b.table(spark, sf, "conversations").where("role = 'user'").select(split)
    return cleaning.name_list(first, second)


# A third of the texts gets Cyrillic and a third Greek letters in place of their own, which fold back.
@query(f"""
SELECT doc_id, {_fold("text")} || CASE doc_id % 3 WHEN 0 THEN ' shchuka iuzhnyi' WHEN 1 THEN ' dokime psukhe' ELSE '' END AS plain
FROM documents""")
def other_scripts(spark, sf):
    """Texts in other scripts, transliterated."""
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    cyrillic = F.concat(F.translate(F.lower("text"), "abvgdeiklmnoprstu", "абвгдеиклмнопрсту"), F.lit(" Щука Южный"))
    greek = F.concat(F.translate(F.lower("text"), "abgdeklmnxoprtu", "αβγδεκλμνξοπρτυ"), F.lit(" Δοκιμή Ψυχή"))
    mixed = F.when(F.col("doc_id") % 3 == 0, cyrillic).when(F.col("doc_id") % 3 == 1, greek).otherwise(F.col("text"))
    return docs.select("doc_id", text.normalize(mixed).alias("plain"))


@query(f"""
SELECT t AS word, count(*) AS n FROM (SELECT unnest({_tokens("text")}) AS t FROM documents)
WHERE t IN ({_STOPS}) GROUP BY t""")
def stopword_hits(spark, sf):
    documents = spread(b.table(spark, sf, "documents").select("text"))
    tokens = one_row_each(
        documents.select(text.raw_tokens(F.col("text")).alias("tokens")), "tokens", "word"
    )
    return (
        tokens.where(F.col("word").isin(sorted(text.stopwords())))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(f"""
SELECT CAST(d.doc_id AS VARCHAR) AS "Id", coalesce({_cleaned("p_name", False)}, '') AS "Título",
  coalesce({_cleaned("d.text", False)}, '') AS "DESCRIÇÃO DO CHAMADO", source AS "Time"
FROM documents d LEFT JOIN part ON p_partkey = d.doc_id""")
def prepared_tickets(spark, sf):
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    raw = spread(b.table(spark, sf, "documents"), "doc_id").join(part, "doc_id", "left")
    return prepare.clean_tickets(
        raw.select(
            F.col("doc_id").cast("string").alias("Id"),
            F.col("p_name").alias("Título"),
            F.col("text").alias("DESCRIÇÃO DO CHAMADO"),
            F.col("source").alias("Time"),
        )
    )


# Terms and distribution


def _documents(spark, sf):
    return b.assigned(spark, sf, text_work=True).select("system", "id", "topic", "text")


@query(with_(ASSIGN, TERMS) + """
SELECT system, topic, term, CAST(tf AS BIGINT) AS tf, f, round(weight, 8) AS weight FROM weights""")
def term_weights(spark, sf):
    return terms.term_weights(_documents(spark, sf)).withColumn("weight", F.round("weight", 8))


@query(with_(ASSIGN, TERMS) + "SELECT system, topic, term, score, CAST(rank AS INTEGER) AS rank FROM terms")
def topic_terms(spark, sf):
    return terms.topic_terms(terms.term_weights(_documents(spark, sf)))


@query(with_(ASSIGN, TERMS) + """
SELECT system, topic, string_agg(term, ', ' ORDER BY rank) AS keywords,
  string_agg('''' || term || '''', ', ' ORDER BY rank) AS quoted
FROM terms WHERE rank <= 8 GROUP BY system, topic""")
def keyword_string(spark, sf):
    top = terms.topic_terms(terms.term_weights(_documents(spark, sf)))
    return terms.first_keywords(top).select(
        "system",
        "topic",
        text.keyword_string(F.col("terms")).alias("keywords"),
        text.quoted_keyword_string(F.col("terms")).alias("quoted"),
    )


@query(with_(ASSIGN, COUNTS, TERMS) + """
SELECT system, topic, n AS n_documents, words FROM counts LEFT JOIN (
  SELECT system, topic, string_agg(term, ' ' ORDER BY rank) AS words FROM terms GROUP BY system, topic)
USING (system, topic)""")
def topic_info(spark, sf):
    documents = _documents(spark, sf)
    info = terms.topic_info(documents, terms.topic_terms(terms.term_weights(documents)))
    return info.select("system", "topic", "n_documents", F.array_join("terms", " ").alias("words"))


_DISTRIBUTION = r"""tokens AS (
  SELECT system, id, unnest(words) AS term, generate_subscripts(words, 1) AS pos, len(words) AS n
  FROM (SELECT system, id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS words FROM assign)),
windows AS (
  SELECT system, id, pos - o AS w, term FROM tokens, (SELECT unnest(range(4)) AS o)
  WHERE (n >= 4 AND pos - o BETWEEN 1 AND n - 3) OR (n < 4 AND o = pos - 1)),
members AS (
  SELECT system, id, w, term, count(*) AS c FROM windows GROUP BY system, id, w, term),
idf AS (SELECT system, term, any_value(idf) AS idf FROM weights GROUP BY system, term),
lengths AS (
  SELECT system, id, w, sqrt(sum(c * c * idf * idf)) AS length
  FROM members JOIN idf USING (system, term) GROUP BY system, id, w),
norms AS (SELECT system, topic, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY system, topic),
shares AS MATERIALIZED (
  SELECT t.system, t.term, t.topic, idf * weight / norm AS share
  FROM weights t JOIN norms n ON n.system = t.system AND n.topic = t.topic),
dots AS MATERIALIZED (
  SELECT m.system, m.id, m.w, s.topic, sum(m.c * s.share) AS dot
  FROM members m JOIN shares s ON m.system = s.system AND m.term = s.term
  GROUP BY m.system, m.id, m.w, s.topic),
cosines AS (
  SELECT d.system, d.id, d.w, d.topic, dot / length AS cosine
  FROM dots d JOIN lengths l ON l.system = d.system AND l.id = d.id AND l.w = d.w),
mass AS (
  SELECT system, id, topic, sum(cosine) AS mass FROM cosines WHERE cosine >= 0.1 GROUP BY system, id, topic),
dist AS (
  SELECT system, id, topic,
    CAST(round_even(mass / sum(mass) OVER (PARTITION BY system, id), 4) AS DOUBLE) AS prob FROM mass)"""


def _distribution(spark, sf):
    # Counts and windows read the texts: they meet their topics once.
    documents = spread(stored(_documents(spark, sf)), "id")
    return distribution.topic_distribution(
        documents.select("system", "id", "text"), stored(terms.term_weights(documents))
    )


@query(with_(ASSIGN, TERMS, _DISTRIBUTION) + "SELECT system, id, topic, prob FROM dist")
def ticket_topic_distribution(spark, sf):
    return _distribution(spark, sf)


@query(with_(ASSIGN, TERMS, _DISTRIBUTION) + "SELECT a.system, a.id, " + ", ".join(
    f'coalesce(max(prob) FILTER (d.topic = {t}), 0) AS "Topico {t}"' for t in range(10)
) + """, any_value(a.topic) AS dominant_topic
FROM assign a LEFT JOIN dist d ON a.system = d.system AND a.id = d.id GROUP BY a.system, a.id""")
def distribution_wide(spark, sf):
    return distribution.wide_distribution(_distribution(spark, sf), b.assignments(spark, sf), 10)


# Labelled vectors


def _labelled(spark, sf):
    return b.assigned(spark, sf).select("system", "topic", "id", "embedding")


@query(with_(ASSIGN, CENTROIDS, COUNTS) + """
SELECT system, topic, n AS n_documents, unnest(range(len(centroid))) AS d,
  round(unnest(centroid), 6) + 0 AS value FROM centroids JOIN counts USING (system, topic)""")
def topic_centroids(spark, sf):
    centroids = clusters.topic_centroids(_labelled(spark, sf))
    return centroids.select("system", "topic", "n_documents", F.posexplode("centroid")).select(
        "system",
        "topic",
        "n_documents",
        F.col("pos").cast("bigint").alias("d"),
        (F.round("col", 6) + F.lit(0.0)).alias("value"),
    )


@query(with_(ASSIGN, CENTROIDS) + """
SELECT system, round(sum(list_sum(list_transform(list_zip(embedding, centroid),
    lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS wcss, count(DISTINCT topic) AS k
FROM assign JOIN centroids USING (system, topic) GROUP BY system""")
def wcss_by_label(spark, sf):
    return clusters.inertia(_labelled(spark, sf)).withColumn("wcss", F.round("wcss", 6))


@query(with_(ASSIGN) + """
, gaps AS (
  SELECT p.system, p.id, p.topic, q.topic AS other, count(*) FILTER (p.id <> q.id) AS n,
    sum(list_dot_product(p.embedding, p.embedding) + list_dot_product(q.embedding, q.embedding)
      - 2 * list_dot_product(p.embedding, q.embedding)) AS total
  FROM assign p JOIN assign q ON p.system = q.system GROUP BY p.system, p.id, p.topic, q.topic),
ab AS (
  SELECT system, id, max(total / n) FILTER (topic = other AND n > 0) AS a,
    min(total / n) FILTER (topic <> other) AS b
  FROM gaps GROUP BY system, id)
SELECT system, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0
  ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n_documents
FROM ab GROUP BY system""")
def silhouette_sq(spark, sf):
    scored = clusters.silhouette_sq(_labelled(spark, sf))
    return scored.withColumn("silhouette", F.round("silhouette", 6))


@query(with_(ASSIGN) + """
, gaps AS (
  SELECT p.system, p.id, p.topic, q.topic AS other, count(*) FILTER (p.id <> q.id) AS n,
    sum(list_distance(p.embedding, q.embedding)) AS total
  FROM assign p JOIN assign q ON p.system = q.system GROUP BY p.system, p.id, p.topic, q.topic),
ab AS (
  SELECT system, id, max(total / n) FILTER (topic = other AND n > 0) AS a,
    min(total / n) FILTER (topic <> other) AS b
  FROM gaps GROUP BY system, id)
SELECT system, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0
  ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n_documents
FROM ab GROUP BY system""")
def silhouette_euclidean(spark, sf):
    scored = clusters.silhouette_euclidean(_labelled(spark, sf))
    return scored.withColumn("silhouette", F.round("silhouette", 6))


@query(with_(ASSIGN) + """
SELECT id, unnest(range(len(embedding))) AS d,
  round(unnest(embedding) * 3 / (3 * sqrt(list_dot_product(embedding, embedding))), 6) + 0 AS value
FROM assign""")
def unit_vectors(spark, sf):
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    rows = _labelled(spark, sf).select("id", F.posexplode(vectors.unit(scaled)))
    return rows.select(
        "id", F.col("pos").cast("bigint").alias("d"), (F.round("col", 6) + F.lit(0.0)).alias("value")
    )


# Choice of tickets

_COSINE = """cosine AS (
  SELECT system, topic, id, position, text,
    round(list_dot_product(embedding, centroid) / sqrt(list_dot_product(centroid, centroid)), 6) AS prob
  FROM assign JOIN centroids USING (system, topic))"""
_CORE = """core AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system, topic ORDER BY prob DESC, id) AS rank
    FROM cosine) WHERE rank <= 30)"""
_PERIPHERY = """periphery AS (
  SELECT * FROM (
    SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY system, topic ORDER BY md5('42|' || id), id) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY system, topic ORDER BY prob DESC, id) AS rank FROM cosine)
    WHERE rank > 30) WHERE rank <= 15)"""
_FALLBACK = """fallback AS (
  SELECT *, CASE WHEN rank <= 30 THEN 'core' ELSE 'periphery' END AS part FROM (
    SELECT system, topic, id, position, text,
      row_number() OVER (PARTITION BY system, topic ORDER BY md5('42|' || id), id) AS rank
    FROM assign WHERE text IS NOT NULL) WHERE rank <= 45)"""
_SELECTED = """chosen AS (
  SELECT system, topic, id, position AS place, text, 'core' AS part FROM core WHERE system IN ('en', 'es')
  UNION ALL
  SELECT system, topic, id, position, text, 'periphery' FROM periphery WHERE system IN ('en', 'es')
  UNION ALL
  SELECT system, topic, id, rank, text, part FROM fallback WHERE system NOT IN ('en', 'es')),
selected AS (
  SELECT system, topic, part, id, text,
    CAST(row_number() OVER (PARTITION BY system, topic, part ORDER BY place, id) AS INTEGER) AS number
  FROM chosen WHERE text IS NOT NULL)"""
_CHOICE = with_(ASSIGN, CENTROIDS, _COSINE, _CORE, _PERIPHERY, _FALLBACK, _SELECTED)


@query(with_(ASSIGN, CENTROIDS, _COSINE, _CORE) + """
SELECT system, topic, id, prob, CAST(rank AS INTEGER) AS rank FROM core""")
def core_tickets(spark, sf):
    return selection.core_tickets(b.own_cosine(spark, sf))


@query(with_(ASSIGN, CENTROIDS, _COSINE, _PERIPHERY) + """
SELECT system, topic, id, CAST(rank AS INTEGER) AS rank FROM periphery""")
def periphery_tickets(spark, sf):
    return selection.periphery_tickets(b.own_cosine(spark, sf))


@query(with_(ASSIGN, _FALLBACK) + """
SELECT system, topic, id, part, CAST(rank AS INTEGER) AS rank FROM fallback""")
def fallback_tickets(spark, sf):
    return selection.fallback_tickets(b.assignments(spark, sf))


@query(_CHOICE + "SELECT system, topic, part, number, id, text FROM selected")
def ticket_selection(spark, sf):
    return b.selected(spark, sf)


_BLOCKS = """blocks AS (
  SELECT system, topic, count(*) FILTER (part = 'core') AS n_core,
    count(*) FILTER (part = 'periphery') AS n_periphery,
    '=== NÚCLEO (mais representativos do tópico) ===' || chr(10)
    || string_agg('Chamado N' || number || ': ' || text, chr(10) ORDER BY number) FILTER (part = 'core')
    || coalesce(chr(10) || chr(10) || '=== PERIFERIA (variações do mesmo tópico) ===' || chr(10)
      || string_agg('Chamado P' || number || ': ' || text, chr(10) ORDER BY number)
         FILTER (part = 'periphery'), '') AS block
  FROM selected GROUP BY system, topic),
quoted AS (
  SELECT system, topic, string_agg('''' || term || '''', ', ' ORDER BY rank) AS words
  FROM terms GROUP BY system, topic)"""
_PROMPTS = """SELECT system, topic, CAST(n_core AS INTEGER) AS n_core, CAST(n_periphery AS INTEGER) AS n_periphery,
  'Keywords do tópico: ' || coalesce(words, '(não disponível)') || chr(10) || chr(10) || block AS content
FROM blocks LEFT JOIN quoted USING (system, topic) WHERE block IS NOT NULL"""


@query(_CHOICE + ", " + TERMS + ", " + _BLOCKS + _PROMPTS)
def prompt_batch(spark, sf):
    top = terms.topic_terms(terms.term_weights(_documents(spark, sf)))
    return summaries.summary_prompts(b.selected(spark, sf), top)


@query(_CHOICE + ", " + TERMS + ", " + _BLOCKS + _PROMPTS + " AND topic NOT IN (SELECT r_regionkey FROM region)")
def summary_jobs(spark, sf):
    top = terms.topic_terms(terms.term_weights(_documents(spark, sf)))
    ranked = b.own_cosine(spark, sf).where(F.col("system").isin("en", "es"))
    return summaries.summary_jobs(
        b.tickets(spark, sf),
        b.assignments(spark, sf),
        ranked,
        top,
        b.titles(spark, sf),
    )


# Answers of the language model

_RESPONSES = r"""responses AS (
  SELECT CAST(u.conv_id AS VARCHAR) AS system, CAST(u.turn AS INTEGER) AS topic,
    chr(10) || '**Padrão Dominante**: ' || u.text || coalesce(
      chr(10) || '**Impacto Operacional**:' || chr(10) || a.text || chr(10), '') AS r, u.text AS ut, a.text AS at
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""


def _responses(spark, sf):
    """Each turn followed by the next one as a two-field answer; the last has one field."""
    turns = b.table(spark, sf, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    impact = F.concat(F.lit(f"\n{names.IMPACT_LABEL}:\n"), "next", F.lit("\n"))
    return turns.join(following, ["conv_id", "turn"], "left").select(
        F.col("conv_id").cast("string").alias("system"),
        F.col("turn").cast("int").alias("topic"),
        F.concat(
            F.lit(f"\n{names.PATTERN_LABEL}: "), "text", F.coalesce(impact, F.lit(""))
        ).alias("response_text"),
    )


@query(f"WITH {_RESPONSES}" + r"""
SELECT system, topic, regexp_replace(r, '^\s+|\s+$', '', 'g') AS text,
  regexp_replace(substr(r, instr(r, '**Padrão Dominante**:') + 21,
    CASE WHEN instr(r, '**Impacto Operacional**') > 0
      THEN instr(r, '**Impacto Operacional**') - instr(r, '**Padrão Dominante**:') - 21 ELSE length(r) END),
    '^\s+|\s+$', '', 'g') AS pattern,
  CASE WHEN instr(r, '**Impacto Operacional**:') > 0 THEN regexp_replace(
    substr(r, instr(r, '**Impacto Operacional**:') + 24), '^\s+|\s+$', '', 'g') ELSE '' END AS impact,
  contains(r, '**Padrão Dominante**') AND contains(r, '**Impacto Operacional**') AS valid
FROM responses""")
def summary_parse(spark, sf):
    return summaries.checked_summaries(_responses(spark, sf))


@query("""
SELECT p_brand AS system, CAST(p_partkey AS INTEGER) AS topic,
  CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'Tópico ' || p_partkey
    WHEN 3 THEN p_name ELSE 'Tópico ' || p_partkey END AS text FROM part""")
def title_cleanup(spark, sf):
    part = b.table(spark, sf, "part")
    number = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 5
    answer = (
        F.when(kind == 0, F.concat(F.lit('"'), "p_name", F.lit('"\n')))
        .when(kind == 1, F.concat(number, F.lit(". "), "p_name"))
        .when(kind == 2, F.concat(number, F.lit(".")))
        .when(kind == 3, F.concat(F.lit(" '"), "p_name", F.lit("'")))
        .otherwise(F.lit(" "))
    )
    return summaries.cleaned_titles(
        part.select(
            F.col("p_brand").alias("system"),
            F.col("p_partkey").cast("int").alias("topic"),
            answer.alias("response_text"),
        )
    )


@query(with_(ASSIGN, SYSTEMS, SPINE, SUMMARY_TEXTS) + """
SELECT system, topic FROM spine WHERE (system, topic) NOT IN (SELECT (system, topic) FROM titles)""")
def pending_topics(spark, sf):
    return summaries.pending(topic_spine(b.systems(spark, sf)), b.titles(spark, sf))


@query(with_(ASSIGN, SYSTEMS, SPINE, SUMMARY_TEXTS) + """
, used AS (SELECT system, string_agg('- ' || text, chr(10) ORDER BY topic) AS used FROM titles GROUP BY system)
SELECT s.system, s.topic, coalesce('[ALREADY USED TITLES — DO NOT REPEAT OR PARAPHRASE]' || chr(10) || used
  || chr(10) || chr(10), '') || '[TOPIC SUMMARY]' || chr(10) || s.text AS content
FROM summaries s LEFT JOIN used USING (system)
WHERE (s.system, s.topic) NOT IN (SELECT (system, topic) FROM titles)""")
def title_prompts(spark, sf):
    return summaries.title_prompts(b.summaries(spark, sf), b.titles(spark, sf))
