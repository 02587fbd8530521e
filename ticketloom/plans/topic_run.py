"""Topic model of every system and all its artifacts, stage by stage."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.operators import clusters, distribution, modeling, terms
from ticketloom.operators.lloyd import Fit
from ticketloom.operators.scale import stored
from ticketloom.plans import vector_store
from ticketloom.sources import writers
from ticketloom.sources.ledger import Ledger, content_digest, digest

# To be raised when a stage computes something else from the same inputs.
VERSION = 1


@dataclass(frozen=True)
class TopicModel:
    """A reducer and the centres over what it gives."""

    reducer: PipelineModel
    centres: Fit

    def transform(self, vectors: DataFrame) -> DataFrame:
        """Adds ``prediction`` to rows with ``embedding``."""
        raw = vectors.withColumn("_raw", array_to_vector(F.col("embedding").cast("array<double>")))
        made = self.centres.transform(self.reducer.transform(raw))
        return made.select(*vectors.columns, "prediction")

    def write(self, spark: SparkSession, path: str) -> None:
        self.reducer.write().overwrite().save(f"{path}/reducer")
        self.centres.write(spark, f"{path}/centres")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TopicModel:
        return cls(PipelineModel.load(f"{path}/reducer"), Fit.read(spark, f"{path}/centres"))


def with_vectors(spark: SparkSession, documents: DataFrame, path: str) -> DataFrame:
    """``id, text, embedding``: own vectors, or those of the built-in encoder, kept by content.

    The encoder's document frequencies are part of its fingerprint: they follow from the texts.
    """
    if "embedding" in documents.columns:
        return documents.select("id", "text", "embedding")
    texts = documents.select("id", "text")
    encoder = digest("hashed tf-idf", VERSION, content_digest(texts, "text"))
    model = modeling.text_encoder(texts)
    vectors = vector_store.refresh(spark, path, texts, lambda rows: modeling.encode(model, rows), encoder)
    return texts.join(vectors, "id")


def fitted(vectors: DataFrame, k: int, n_init_search: int, n_init_final: int, components, metrics) -> tuple[TopicModel, dict, DataFrame]:
    """The model of the best setting, what was chosen and measured, and the table of all runs."""
    grid = modeling.grid_search(vectors, k, components, metrics, n_init_search)
    reduced, reducer = modeling.reduce_vectors(vectors.select("embedding"), grid.components, grid.metric)
    reduced = stored(reduced.select(vector_to_array("features").alias("_x"))).select(array_to_vector("_x").alias("features"))
    best, cost = modeling.best_kmeans(reduced, k, n_init_final)
    score = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(best.transform(reduced))
    notes = {
        "n_components": grid.components, "metric": grid.metric,
        "silhouette_sq": round(float(score), 4), "wcss": float(cost), "steps": best.steps,
    }
    return TopicModel(reducer, best), notes, grid.runs


def run_system(
    spark: SparkSession,
    documents: DataFrame,
    system: str,
    k: int,
    path: str,
    n_init_search: int = 10,
    n_init_final: int = 20,
    components=modeling.GRID_COMPONENTS,
    metrics=modeling.GRID_METRICS,
) -> DataFrame:
    """Make the topic model of one system and what follows from it, or what of it is out of date.

    ``documents``: ``id, text`` and ready vectors in ``embedding``, if any. The result is the
    assignment ``system, id, topic``. Every table goes to ``path/<table>/system=<system>`` and
    every stage to the ledger: with the same rows and parameters nothing is fitted again, with
    others the run starts at the first stage that they change.
    """
    folder = lambda table: f"{path}/{table}/system={system}"
    ledger = Ledger(spark, f"{path}/stages/{system}")
    held = ["id", "text"] + [c for c in ("embedding",) if c in documents.columns]
    source = content_digest(documents, *held)

    def read(table: str) -> DataFrame:
        return spark.read.parquet(folder(table)).withColumn("system", F.lit(system))

    def make_vectors() -> None:
        rows = with_vectors(spark, documents, f"{path}/vectors/{system}")
        rows.write.mode("overwrite").parquet(folder("inputs"))

    vectors_digest, _ = ledger.stage("inputs", VERSION, {}, [source], make_vectors)
    vectors = spark.read.parquet(folder("inputs"))
    options = {"k": k, "search": n_init_search, "final": n_init_final, "components": list(components), "metrics": list(metrics), "seed": names.SEED}

    def make_model() -> dict:
        model, notes, runs = fitted(vectors, k, n_init_search, n_init_final, components, metrics)
        runs.write.mode("overwrite").parquet(folder("grid"))
        model.write(spark, f"{path}/models/{system}")
        writers.write_record(spark, notes, folder("metrics"))
        return notes

    model_digest, chosen = ledger.stage("model", VERSION, options, [vectors_digest], make_model)

    def make_assignments() -> None:
        placed = TopicModel.read(spark, f"{path}/models/{system}").transform(vectors.select("id", "embedding"))
        modeling.renumbered(placed).select("id", "topic").write.mode("overwrite").parquet(folder("assignments"))

    assigned_digest, _ = ledger.stage("assignments", VERSION, {}, [model_digest], make_assignments)
    labelled = lambda: vectors.join(read("assignments"), "id")

    def make_terms() -> None:
        terms.term_weights(labelled()).drop("system").write.mode("overwrite").parquet(folder("weights"))
        terms.topic_terms(read("weights")).drop("system").write.mode("overwrite").parquet(folder("terms"))

    terms_digest, _ = ledger.stage("terms", VERSION, {"n": names.TOP_TERMS}, [assigned_digest], make_terms)

    def make_distribution() -> None:
        shares = distribution.topic_distribution(labelled().select("system", "id", "text"), read("weights"))
        shares.drop("system").write.mode("overwrite").parquet(folder("distribution"))

    ledger.stage("distribution", VERSION, {}, [terms_digest], make_distribution)

    def make_coordinates() -> None:
        clusters.topic_centroids(labelled()).drop("system").write.mode("overwrite").parquet(folder("centroids"))
        modeling.topic_coordinates(read("centroids")).drop("system").write.mode("overwrite").parquet(folder("coordinates"))

    ledger.stage("coordinates", VERSION, {}, [assigned_digest], make_coordinates)
    record = {"system": system, "seed": names.SEED, "nr_topics": k, "reused": "model" not in ledger.made, **chosen}
    writers.write_record(spark, record, folder("parameters"))
    return read("assignments").select("system", "id", "topic")


def run_all(
    spark: SparkSession,
    documents: DataFrame,
    topics_per_system: Mapping[str, int],
    path: str,
    minimum: int = names.MIN_DOCUMENTS,
    **options,
) -> list[str]:
    """Topic models of all systems with enough documents; returns the systems done.

    The list of systems is a parameter and short; each round is a set of Spark jobs
    over that system's partition of the documents.
    """
    sizes = documents.where(F.col("text").isNotNull()).groupBy("system").count()
    wanted = sizes.where(F.col("system").isin(list(topics_per_system)))
    counts = {row["system"]: row["count"] for row in wanted.collect()}
    done = []
    for system, k in topics_per_system.items():
        if counts.get(system, 0) < minimum:
            continue
        own = documents.where((F.col("system") == system) & F.col("text").isNotNull())
        run_system(spark, own, system, k, path, **options)
        done.append(system)
    return done
