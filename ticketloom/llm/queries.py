"""Queries of the pipeline operators over the whole tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ticketloom.llm import (
    backoff_lm,
    best_two_fit,
    blob_ledger,
    chat_repair,
    chat_tools,
    curriculum,
    decontaminate,
    extendible,
    metric_join,
    mixture_langid,
    tensor_minhash,
    term_at_a_time,
    url_digest,
)

# The rules that are asked for.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_tools.from_turns(read(spark, sf_dir, "conversations"))
    return chat_tools.link(calls, results, chat_tools.TOOLS)


def op2_url_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_digest.judge(read(spark, sf_dir, "pages"), rules)


def op3_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.near_dedup(read(spark, sf_dir, "documents"), words=4)


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.exact_dedup(read(spark, sf_dir, "documents"))


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit.pack(read(spark, sf_dir, "documents"))


def op7_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blob_ledger.scan(read(spark, sf_dir, "documents"))
    spans = blob_ledger.rendered(F.col("findings"))
    counts = [blob_ledger.of_kind(F.col("findings"), k).alias(f"n_{k}") for k in blob_ledger.KINDS]
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op8_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_langid.identify(read(spark, sf_dir, "documents"))


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.scores(read(spark, sf_dir, "documents"))


def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(read(spark, sf_dir, "documents"))


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.audits(chat_repair.damaged(read(spark, sf_dir, "conversations")))


def op12_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_at_a_time.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_tool_calls": op1_tool_calls,
    "op2_url_digest": op2_url_digest,
    "op3_tensor_minhash": op3_tensor_minhash,
    "op4_metric_join": op4_metric_join,
    "op5_extendible_dedup": op5_extendible_dedup,
    "op6_best_two_fit": op6_best_two_fit,
    "op7_blob_ledger": op7_blob_ledger,
    "op8_mixture_langid": op8_mixture_langid,
    "op9_backoff_lm": op9_backoff_lm,
    "op10_curriculum": op10_curriculum,
    "op11_chat_repair": op11_chat_repair,
    "op12_term_at_a_time": op12_term_at_a_time,
    "op13_decontaminate": op13_decontaminate,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URL_SQL = rf"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
found AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN found f ON p.page_id = f.page_id
"""

EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

# Places follow from the texts between matches, whose lengths add up with those of the matches.
SECRET_PATTERNS = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
VALUE = "[A-Za-z0-9+/_.=-]+"


def _secret_sql() -> str:
    parts = []
    for number, (kind, pattern) in enumerate(SECRET_PATTERNS.items()):
        whole = pattern + (VALUE if kind == "assign" else "")
        wide = {
            "assign": f"length(regexp_extract(m, '^{pattern}({VALUE})$', 1)) >= 6",
            "access": "length(m) >= 20",
            "hex": "length(m) >= 24",
        }[kind]
        parts.append(
            f"""{kind} AS (
  SELECT doc_id, {number} AS kind, m, sum(length(g)) OVER w + sum(length(m)) OVER w - length(m) AS start
  FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{whole}')) AS m,
               unnest(regexp_split_to_array(t, '{whole}')) AS g,
               generate_subscripts(regexp_split_to_array(t, '{whole}'), 1) AS i FROM texts)
  WHERE m IS NOT NULL
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
{kind}_kept AS (SELECT doc_id, kind, CAST(start AS BIGINT) AS s, CAST(start + length(m) AS BIGINT) AS e FROM {kind} WHERE {wide})"""
        )
    names = "['assign', 'access', 'hex']"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(parts)},
spans AS (SELECT * FROM assign_kept UNION ALL SELECT * FROM access_kept UNION ALL SELECT * FROM hex_kept),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex,
         string_agg(({names})[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""


MIX_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS mark FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sources),
weighed AS (
  SELECT *, [5, 2, 1][turn + 1] AS weight, [0.5::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE][turn + 1] AS slope,
         source_size * 2 AS cap FROM ranked),
levels AS (
  SELECT *, row_number() OVER f AS place,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE)
           / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM weighed
  WINDOW f AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST),
         b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT l.source, l.source_size, l.slope, least(l.cap::DOUBLE, coalesce(c.level * l.weight, 0)) AS target
  FROM levels l CROSS JOIN chosen c),
placed AS (
  SELECT r.*, t.source_size, t.slope, t.target,
         CAST(sum(size) OVER (PARTITION BY r.source ORDER BY mark, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS INTEGER) ELSE 0 END AS whole
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
firsts AS (
  SELECT *, target - whole * source_size AS rest,
         size > 0 AND start + size <= target - whole * source_size AS first FROM placed),
gaps AS (
  SELECT source, max(rest) - coalesce(max(start + size) FILTER (first), 0) AS gap FROM firsts GROUP BY source),
sizes AS (
  SELECT f.source, f.size, count(*) AS n, row_number() OVER (PARTITION BY f.source ORDER BY f.size DESC) AS k
  FROM firsts f JOIN gaps g ON f.source IS NOT DISTINCT FROM g.source
  WHERE NOT first AND f.size > 0 AND f.size < g.gap * 2 GROUP BY f.source, f.size),
walk AS (
  SELECT source, 0::BIGINT AS k, gap AS room, 0::BIGINT AS size, 0::BIGINT AS take, 0::BIGINT AS n FROM gaps
  UNION ALL
  SELECT w.source, s.k, w.room - s.size * CAST(least(s.n, floor(w.room / s.size)) AS BIGINT), s.size,
         CAST(least(s.n, floor(w.room / s.size)) AS BIGINT), s.n
  FROM walk w JOIN sizes s ON w.source IS NOT DISTINCT FROM s.source AND s.k = w.k + 1),
rooms AS (SELECT source, arg_max(room, k) AS room FROM walk GROUP BY source),
nearest AS (
  SELECT w.source, min(w.size) AS size FROM walk w JOIN rooms r ON w.source IS NOT DISTINCT FROM r.source
  WHERE w.take < w.n AND w.size > r.room AND w.size < r.room * 2 GROUP BY w.source),
fills AS (
  SELECT w.source, w.size, w.take + CAST(n.size IS NOT NULL AS BIGINT) AS take
  FROM walk w LEFT JOIN nearest n ON w.source IS NOT DISTINCT FROM n.source AND w.size = n.size WHERE w.k > 0),
nths AS (
  SELECT *, row_number() OVER (PARTITION BY source, size, first ORDER BY start) AS nth FROM firsts),
extras AS (
  SELECT f.*, coalesce(NOT first AND f.size > 0 AND nth <= l.take, false) AS extra
  FROM nths f LEFT JOIN fills l ON f.source IS NOT DISTINCT FROM l.source AND f.size = l.size),
taken AS (
  SELECT *, CASE WHEN size > 0 THEN whole + CAST(first OR extra AS INTEGER) ELSE 0 END AS copies FROM extras),
timed AS (
  SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE,
           CASE WHEN extra AND whole = 0 THEN target - size / 2.0::DOUBLE ELSE start + size / 2.0::DOUBLE END / target)) AS y
  FROM taken)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, floor(target * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN
         floor(y * 2 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + slope * 4 * y)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE END AS position
FROM timed
"""

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORDS}')"


RANK_SQL = f"""
WITH docs AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) GROUP BY doc_id, term),
lengths AS (SELECT doc_id, len(w) AS n FROM docs WHERE len(w) > 0),
sums AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM lengths),
asked AS (SELECT DISTINCT item_id, unnest({_words_sql("text")}) AS term FROM benchmark),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(s.N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM counted CROSS JOIN (SELECT N FROM sums) s WHERE term IN (SELECT term FROM asked) GROUP BY term),
scored AS (
  SELECT a.item_id, c.doc_id,
         CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * l.n * s.N) // s.L))))) AS BIGINT) AS score
  FROM asked a JOIN weighed w ON a.term = w.term JOIN counted c ON c.term = a.term
  JOIN lengths l ON l.doc_id = c.doc_id CROSS JOIN sums s
  GROUP BY a.item_id, c.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""

LEAK_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words_sql("text")} AS w FROM benchmark),
spots AS (
  SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM spots),
docs AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM grams),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes),
hits AS (
  SELECT p.doc_id, p.i, p.size, g.item
  FROM places p JOIN grams g ON g.size = p.size AND array_to_string(p.w[p.i : p.i + p.size - 1], ' ') = g.gram),
words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits)
  GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN words h ON d.doc_id = h.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""

ORACLES = {
    "op2_url_digest": URL_SQL,
    "op5_extendible_dedup": EXACT_SQL,
    "op7_blob_ledger": _secret_sql(),
    "op10_curriculum": MIX_SQL,
    "op12_term_at_a_time": RANK_SQL,
    "op13_decontaminate": LEAK_SQL,
}
