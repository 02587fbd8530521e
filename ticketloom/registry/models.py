"""Embedding, reduction and clustering. Fits have no SQL twin; what can be checked does."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import vectors
from ticketloom.operators import clusters, lloyd, modeling
from ticketloom.operators.scale import shared_folder, spread, stored
from ticketloom.plans import topic_run, vector_store
from ticketloom.registry import bindings as b
from ticketloom.registry.core import query
from ticketloom.sources import readers, writers
from ticketloom.sources.ledger import content_digest, digest

# Topics of a system; 3 where it is not listed.
TOPICS = {"en": 5}


def _vectors(spark, sf):
    return spread(b.table(spark, sf, "embeddings"), "vec_id").select(
        F.col("vec_id").cast("string").alias("id"), "embedding"
    )


@query()
def text_embedding(spark, sf):
    """Hashed TF-IDF of every document: non-zero entries and length of the vector."""
    documents = spread(b.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    encoded = modeling.encode(modeling.text_encoder(documents), documents)
    return encoded.select(
        "doc_id",
        F.size(F.filter("embedding", lambda x: x != 0)).alias("nonzero"),
        F.round(vectors.norm(F.col("embedding")), 4).alias("length"),
    )


@query()
def reduced_vectors(spark, sf):
    """Five principal components of every vector."""
    reduced, _ = modeling.reduce_vectors(_vectors(spark, sf), 5)
    at = vector_to_array("features")
    return reduced.select("id", *[F.round(at[i], 6).alias(f"c{i}") for i in range(5)])


@query()
def kmeans_topics(spark, sf):
    """Topic of every vector, numbered by falling size."""
    reduced, _ = modeling.reduce_vectors(_vectors(spark, sf), 5)
    reduced = stored(reduced.select("id", vector_to_array("features").alias("_x")))
    features = reduced.select("id", array_to_vector("_x").alias("features"))
    best, _ = modeling.best_kmeans(features, 10)
    return modeling.renumbered(best.transform(features)).select("id", "topic")


def _step_sql() -> str:
    return """
WITH rows AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:5], lambda x: x) AS x FROM embeddings),
fits(fit, k) AS (VALUES (0, 3), (1, 5), (2, 10)),
centres AS (SELECT fit, CAST(vec_id AS INTEGER) AS centre, x AS c FROM rows JOIN fits ON vec_id < k),
gaps AS (SELECT vec_id, fit, centre, x, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS gap
  FROM rows CROSS JOIN centres),
nearest AS (SELECT fit, vec_id, arg_min(centre, (round(gap, 12), centre)) AS centre, min(gap) AS gap, any_value(x) AS x
  FROM gaps GROUP BY fit, vec_id)
SELECT fit, centre, count(*) AS n, round(sum(gap), 6) AS cost, round(avg(x[1]), 6) + 0 AS first, round(avg(x[5]), 6) + 0 AS fifth
FROM nearest GROUP BY fit, centre"""


@query(_step_sql())
def lloyd_step(spark, sf):
    """One shared pass for 3, 5 and 10 given centres: members, cost and mean of each."""
    rows = b.table(spark, sf, "embeddings").select(
        "vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 5).alias("x")
    )
    first = [r["x"] for r in rows.where("vec_id < 10").orderBy("vec_id").collect()]
    data = lloyd.table(rows.select(array_to_vector("x").alias("features")))
    found = lloyd.means(data, [np.array(first[:k]) for k in (3, 5, 10)])
    mean = lambda d: F.round(F.col("total")[d] / F.col("n"), 6) + F.lit(0.0)
    return found.select("fit", "centre", "n", F.round("cost", 6).alias("cost"), mean(0).alias("first"), mean(4).alias("fifth"))


@query("""
SELECT p_size AS topic, p_partkey, place FROM part JOIN (
  SELECT p_size, CAST(row_number() OVER (ORDER BY count(*) DESC, p_size) - 1 AS INTEGER) AS place
  FROM part GROUP BY p_size) USING (p_size)""")
def topics_by_size(spark, sf):
    part = b.table(spark, sf, "part").select("p_partkey", "p_size")
    numbered = modeling.renumbered(part.withColumn("kept", F.col("p_size")), "p_size")
    return numbered.select(F.col("kept").alias("topic"), "p_partkey", F.col("topic").alias("place"))


@query()
def elbow_curve(spark, sf):
    """Cost of 2 to 25 topics in every system."""
    rows = b.assigned(spark, sf).select("system", "id", "embedding")
    counts = {r["system"]: r["count"] for r in rows.groupBy("system").count().collect()}
    return modeling.elbow_by_system(rows, dict(sorted(counts.items())))


@query()
def grid_search(spark, sf):
    """Silhouette of all six settings over all vectors."""
    return modeling.grid_search(_vectors(spark, sf), 10).runs


@query("""
SELECT p_size AS n_components, p_type AS metric, p_retailprice AS silhouette FROM part
ORDER BY p_retailprice DESC, p_partkey LIMIT 1""")
def best_run(spark, sf):
    """First best row of a results table, here the parts and their prices."""
    runs = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("run"),
        F.col("p_size").alias("n_components"),
        F.col("p_type").alias("metric"),
        F.col("p_retailprice").alias("silhouette"),
    )
    return modeling.best_run(runs)


@query()
def topic_coordinates(spark, sf):
    """Topics of every system in the plane."""
    rows = b.assigned(spark, sf).select("system", "topic", "embedding")
    centroids = stored(clusters.topic_centroids(rows))
    systems = sorted(r["system"] for r in centroids.select("system").distinct().collect())
    placed = [
        modeling.topic_coordinates(centroids.where(F.col("system") == system)) for system in systems
    ]
    return reduce(DataFrame.unionByName, placed)


@query()
def topic_run_tables(spark, sf):
    """Whole topic run, encoder included, over the systems that are large enough, read back from its tables."""
    folder = shared_folder(spark)
    documents = b.assigned(spark, sf, text_work=True).select("system", "id", "text")
    systems = sorted(r["system"] for r in documents.select("system").distinct().collect())
    topic_run.run_all(spark, documents, {system: TOPICS.get(system, 3) for system in systems}, folder, minimum=70)
    assignments = spark.read.parquet(f"{folder}/assignments")
    terms = spark.read.parquet(f"{folder}/terms")
    counted = assignments.groupBy("system", "topic").agg(F.count(F.lit(1)).alias("n_documents"))
    return terms.join(counted, ["system", "topic"]).select(
        "system", "topic", "rank", "term", "score", "n_documents"
    )


@query("""
SELECT CAST(vec_id AS VARCHAR) AS id, label % 2 = 0 AS even, count(*) OVER (PARTITION BY label % 2 = 0) AS n,
  false AS first_loaded, true AS again_loaded, false AS changed_loaded FROM embeddings""")
def model_reuse(spark, sf):
    """A model is loaded for the same rows and parameters and fitted anew for others.

    The rows are moved apart by their label, so that two topics have to be its two kinds.
    """
    folder = f"{shared_folder(spark)}/model"
    away = lambda x, i: x + F.when(i == 0, 50.0 * (F.col("label") % 2)).otherwise(0.0)
    rows = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "label",
        F.transform(F.col("embedding").cast("array<double>"), away).alias("embedding"),
    )
    content = content_digest(rows, "id", "embedding")

    def reused(k):
        def fit():
            reduced, reducer = modeling.reduce_vectors(rows.select("embedding"), 5, "euclidean")
            return topic_run.TopicModel(reducer, modeling.best_kmeans(reduced.select("features"), k)[0])

        return writers.fit_or_load(spark, folder, fit, topic_run.TopicModel.read, digest(content, k))

    _, first = reused(2)
    model, again = reused(2)
    placed = model.transform(rows)
    even = placed.groupBy("prediction").agg((F.avg(F.col("label") % 2) < 0.5).alias("even"), F.count(F.lit(1)).alias("n"))
    found = stored(placed.join(even, "prediction").select("id", "even", "n"))
    _, changed = reused(3)
    flags = {"first_loaded": first, "again_loaded": again, "changed_loaded": changed}
    return found.select("*", *[F.lit(v).alias(name) for name, v in flags.items()])


@query("""
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS encoded_again,
  md5(CASE WHEN doc_id % 7 = 0 THEN text || ' (nova)' ELSE text END) AS of_text FROM documents""")
def vectors_by_content(spark, sf):
    """A second run, with every seventh text changed, encodes those and reads the others back.

    The vectors of this query hold the first digits of the MD5 of their text, so the twin can
    tell which text each of them was made from.
    """
    folder = shared_folder(spark)
    rows = b.tickets(spark, sf).select("id", "text", "position")
    changed = rows.withColumn("text", F.when(F.col("position") % 7 == 0, F.concat("text", F.lit(" (nova)"))).otherwise(F.col("text")))
    digit = lambda at: F.conv(F.substr(F.md5("text"), at + 1, F.lit(1)), 16, 10).cast("float")
    encode = lambda df: df.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(31)), digit))
    vector_store.refresh(spark, folder, rows, encode, "digits").write.format("noop").mode("overwrite").save()
    again = stored(vector_store.missing(spark, folder, changed, "digits").select("id", F.lit(1).alias("encoded_again")))
    vectors = vector_store.refresh(spark, folder, changed, encode, "digits")
    hex_of = F.array_join(F.transform("embedding", lambda x: F.lower(F.hex(x.cast("long")))), "")
    return vectors.join(again, "id", "left").select(
        "id", F.coalesce("encoded_again", F.lit(0)).alias("encoded_again"), hex_of.alias("of_text")
    )


@query("SELECT CAST(vec_id AS VARCHAR) AS id, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def stored_vectors(spark, sf):
    rows = readers.read_vectors(spark, f"{sf}/embeddings.parquet", "vec_id")
    return rows.select(F.col("id").cast("string").alias("id"), F.posexplode("embedding")).select(
        "id", F.col("pos").cast("bigint").alias("d"), F.col("col").cast("double").alias("value")
    )
