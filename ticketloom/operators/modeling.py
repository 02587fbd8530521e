"""Embedding, reduction and clustering of tickets with Spark ML."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.functions.text import words
from ticketloom.operators import clusters, lloyd
from ticketloom.operators.lloyd import Fit
from ticketloom.operators.scale import stored

GRID_COMPONENTS = (5, 10, 15)
GRID_METRICS = ("cosine", "euclidean")


def text_encoder(documents: DataFrame, text: str = "text", features: int = 512) -> PipelineModel:
    """Fit the built-in encoder: hashed TF-IDF of the words, at length one.

    Only the document frequencies are learnt, one number per feature. Quality of a
    sentence model comes from handing ready vectors to the other operators instead.
    """
    tf = HashingTF(numFeatures=features, inputCol="words", outputCol="tf")
    idf = IDF(inputCol="tf", outputCol="tfidf")
    normalizer = Normalizer(inputCol="tfidf", outputCol="unit")
    counted = tf.transform(documents.select(words(F.col(text)).alias("words")))
    return PipelineModel([tf, idf.fit(counted), normalizer])


def encode(encoder: PipelineModel, documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents with an ``embedding`` column."""
    encoded = encoder.transform(
        documents.withColumn("words", words(F.coalesce(F.col(text), F.lit(""))))
    )
    return encoded.withColumn("embedding", vector_to_array("unit", "float32")).drop(
        "words", "tf", "tfidf", "unit"
    )


def reduce_vectors(
    vectors: DataFrame, components: int, metric: str = "cosine"
) -> tuple[DataFrame, PipelineModel]:
    """Principal components of the embeddings in ``features``; vectors at length one for cosine."""
    raw = vectors.withColumn("_raw", array_to_vector(F.col("embedding").cast("array<double>")))
    stages = []
    source = "_raw"
    if metric == "cosine":
        stages.append(Normalizer(inputCol="_raw", outputCol="_unit"))
        source = "_unit"
    pca_input = stages[0].transform(raw) if stages else raw
    pca = PCA(k=components, inputCol=source, outputCol="features").fit(pca_input)
    model = PipelineModel([*stages, pca])
    return model.transform(raw).drop("_raw", "_unit"), model


def best_kmeans(features: DataFrame, k: int, n_init: int = 10, seed: int = names.SEED) -> tuple[Fit, float]:
    """k-means with several starts in shared scans; the lowest cost wins, the first on a tie."""
    best = lloyd.cheapest(lloyd.fit_all(features, [(k, seed + start, None) for start in range(n_init)]))
    return best, best.cost


def renumbered(clustered: DataFrame, label: str = "prediction") -> DataFrame:
    """Topic numbers by falling size; only the table of sizes is ranked."""
    sizes = clustered.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("n").desc(), F.col(label))
    numbers = sizes.select(label, (F.row_number().over(order) - 1).cast("int").alias("topic"))
    return clustered.join(stored(numbers), label).drop(label)


@dataclass(frozen=True)
class GridChoice:
    """Winning setting of a grid search and the table of all runs."""

    components: int
    metric: str
    silhouette: float
    runs: DataFrame


def grid_search(
    vectors: DataFrame,
    k: int,
    components: Iterable[int] = GRID_COMPONENTS,
    metrics: Iterable[str] = GRID_METRICS,
    n_init: int = 10,
    plain_distances: bool = False,
) -> GridChoice:
    """Every setting is fitted and scored; the first best silhouette wins.

    The score is the squared-Euclidean silhouette, linear in the tickets; with
    ``plain_distances`` it is the quadratic plain one, for tables with a unique ``id``.

    The reduction is nested: principal components are ordered, so the widest fit of a metric
    holds the narrower ones, each metric is reduced once, and all starts of all sizes share
    their scans.
    """
    evaluator = ClusteringEvaluator(distanceMeasure="squaredEuclidean")
    sizes = sorted(components)
    rows = []
    for metric in metrics:
        widest, _ = reduce_vectors(vectors, sizes[-1], metric)
        kept = ["id"] if plain_distances else []
        widest = stored(widest.select(*kept, vector_to_array("features").alias("_x")))
        features = widest.select(*kept, array_to_vector("_x").alias("features"))
        settings = [(k, names.SEED + start, size) for size in sizes for start in range(n_init)]
        fits = lloyd.fit_all(features, settings)
        for size in sizes:
            best = lloyd.cheapest([f for f in fits if f.size == size])
            own = widest.select(*kept, array_to_vector(F.slice("_x", 1, size)).alias("features"))
            clustered = best.transform(own)
            score = _plain_silhouette(clustered) if plain_distances else evaluator.evaluate(clustered)
            rows.append((size, metric, round(float(score), 4)))
    runs = vectors.sparkSession.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "run int, n_components int, metric string, silhouette double",
    )
    winner = max(rows, key=lambda row: row[2])
    return GridChoice(*winner, runs)


def _plain_silhouette(clustered: DataFrame) -> float:
    labelled = clustered.select(
        F.lit("all").alias("system"),
        "id",
        F.col("prediction").alias("topic"),
        vector_to_array("features").alias("embedding"),
    )
    return clusters.silhouette_euclidean(labelled).first()["silhouette"]


def best_run(runs: DataFrame) -> DataFrame:
    """The first run with the highest silhouette of a results table."""
    best = F.max_by(
        F.struct("n_components", "metric", "silhouette"),
        F.struct(F.col("silhouette"), -F.col("run")),
    )
    return runs.agg(best.alias("best")).select("best.*")


def elbow_curve(
    vectors: DataFrame,
    ks: Iterable[int] = range(2, 26),
    components: int = 5,
    n_init: int = 10,
) -> DataFrame:
    """Cost per number of topics: ``k, wcss``. All starts of all numbers share their scans."""
    reduced, _ = reduce_vectors(vectors, components)
    settings = [(k, names.SEED + start, None) for k in ks for start in range(n_init)]
    fits = lloyd.fit_all(reduced.select("features"), settings)
    rows = [(k, lloyd.cheapest([f for f in fits if f.k == k]).cost) for k in dict.fromkeys(k for k, _, _ in settings)]
    return vectors.sparkSession.createDataFrame(rows, "k int, wcss double")


def elbow_by_system(
    vectors: DataFrame, systems: Mapping[str, int], ks: Iterable[int] = range(2, 26), **options
) -> DataFrame | None:
    """Elbow curve of every system with at least as many tickets as the largest k."""
    ks = list(ks)
    curves = None
    for system, count in systems.items():
        if count < max(ks):
            continue
        curve = elbow_curve(vectors.where(F.col("system") == system), ks, **options)
        curve = curve.select(F.lit(system).alias("system"), "k", "wcss")
        curves = curve if curves is None else curves.unionByName(curve)
    return curves


def topic_coordinates(centroids: DataFrame) -> DataFrame:
    """Topics of one system in the plane, outliers left out; empty under 3 topics.

    The input has one row per topic, so this is a small job however many tickets
    there are.
    """
    valid = centroids.where("topic >= 0")
    if valid.limit(3).count() < 3:
        return valid.select(
            "system", "topic", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "n_documents"
        ).where(F.lit(False))
    placed, _ = reduce_vectors(valid.withColumnRenamed("centroid", "embedding"), 2, "cosine")
    at = vector_to_array("features")
    return placed.select("system", "topic", at[0].alias("x"), at[1].alias("y"), "n_documents")
