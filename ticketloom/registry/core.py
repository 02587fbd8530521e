"""Registration of queries and the SQL pieces they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its DuckDB twin if it has one."""

    def register(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


# Common table expressions of the twins, in the same terms as bindings.py.
ASSIGN = """assign AS (
  SELECT lang AS system, CAST(doc_id AS VARCHAR) AS id, doc_id AS position, label AS topic,
         text, source AS team, CAST(embedding AS DOUBLE[]) AS embedding
  FROM documents JOIN embeddings ON doc_id = vec_id)"""

DATED = """dated AS (
  SELECT system, id, topic, o_orderdate AS opened
  FROM assign JOIN orders ON o_orderkey = position WHERE o_orderdate IS NOT NULL)"""

SYSTEMS = """systems AS (SELECT system, CAST(max(topic) + 3 AS INTEGER) AS k FROM assign GROUP BY system)"""

SPINE = """spine AS (SELECT system, CAST(unnest(range(k)) AS INTEGER) AS topic FROM systems)"""

COUNTS = """counts AS (SELECT system, topic, count(*) AS n FROM assign GROUP BY system, topic)"""

CENTROIDS = """parts AS (
  SELECT system, topic, d, avg(x) AS v FROM (
    SELECT system, topic, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM assign)
  GROUP BY system, topic, d),
centroids AS (
  SELECT system, topic, list(v ORDER BY d) AS centroid FROM parts GROUP BY system, topic)"""

TERMS = r"""counted AS (
  SELECT system, topic, term, count(*) AS tf FROM (
    SELECT system, topic, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM assign)
  GROUP BY system, topic, term),
topic_size AS (SELECT system, topic, sum(tf) AS words FROM counted GROUP BY system, topic),
mean_size AS (SELECT system, floor(avg(words)) AS a FROM topic_size GROUP BY system),
freq AS (SELECT system, term, sum(tf) AS f FROM counted GROUP BY system, term),
weights AS (
  SELECT c.system, c.topic, c.term, c.tf, CAST(freq.f AS BIGINT) AS f,
         c.tf / words * ln(1 + a / freq.f) AS weight, ln(1 + a / freq.f) AS idf
  FROM counted c JOIN topic_size s ON c.system = s.system AND c.topic = s.topic
  JOIN mean_size m ON c.system = m.system
  JOIN freq ON c.system = freq.system AND c.term = freq.term),
terms AS (
  SELECT system, topic, term, score, rank FROM (
    SELECT system, topic, term, round(weight, 8) AS score,
           row_number() OVER (PARTITION BY system, topic ORDER BY round(weight, 8) DESC, term) AS rank
    FROM weights) WHERE rank <= 10)"""

SUMMARY_TEXTS = """summaries AS (
  SELECT s.system, s.topic,
         '**Padrão Dominante**: ' || n_name || chr(10) || '**Impacto Operacional**: ' || r_name AS text
  FROM spine s JOIN nation ON n_nationkey = s.topic JOIN region ON r_regionkey = n_regionkey),
titles AS (
  SELECT s.system, s.topic, r_name AS text FROM spine s JOIN region ON r_regionkey = s.topic)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
