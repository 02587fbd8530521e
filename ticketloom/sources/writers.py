"""Writers for stage tables and exports."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.sources.ledger import Ledger

# The task functions travel with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_stage(df: DataFrame, path: str, by_system: bool = True) -> DataFrame:
    """A stage table, partitioned by system, read back for the next stage."""
    writer = df.write.mode("overwrite")
    if by_system:
        writer = writer.partitionBy("system")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """CSV export with header; texts with line breaks and quotes survive."""
    df.write.mode("overwrite").csv(
        path, header=True, sep=separator, quote='"', escape='"', encoding="UTF-8"
    )


def write_lines(df: DataFrame, path: str, column: str) -> None:
    """One item per line, no header."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def topic_text_blocks(terms: DataFrame) -> DataFrame:
    """Per topic a heading and its words: ``system, topic, value``."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    joined = F.concat_ws(" ", F.transform(ordered, lambda t: t["term"]))
    grouped = terms.groupBy("system", "topic").agg(joined.alias("words"))
    heading = F.concat(F.lit("\ntopico "), F.col("topic").cast("string"), F.lit(":\n"))
    return grouped.select("system", "topic", F.concat(heading, "words").alias("value"))


def write_topic_texts(terms: DataFrame, path: str) -> None:
    """Topics as readable text, one folder per system."""
    topic_text_blocks(terms).orderBy("system", "topic").select("system", "value").write.mode(
        "overwrite"
    ).partitionBy("system").text(path)


def write_topic_files(rows: DataFrame, path: str, prefix: str) -> None:
    """One text file ``<system>/<prefix><topic>.txt`` for each row of ``system, topic, value``.

    Spark names its own files, so the tasks that hold the rows write these through the file
    system of the path; a repeated task writes the same files again.
    """
    base = path if "://" in path else f"file://{path.removeprefix('file:')}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for system, topic, value in zip(*(c.to_pylist() for c in batch.columns)):
                files, folder = fs.FileSystem.from_uri(f"{base}/{system}")
                files.create_dir(folder)
                with files.open_output_stream(f"{folder}/{prefix}{topic}.txt") as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    wanted = rows.select("system", "topic", "value").where(F.col("value").isNotNull())
    wanted.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def topic_json(terms: DataFrame) -> DataFrame:
    """Per system one JSON object ``{topic: [[word, score], ...]}``: ``system, value``.

    A system has a few topics of a few words, whatever the size of the corpus.
    """
    pair = F.concat(
        F.lit("["), F.to_json(F.array("term")).substr(F.lit(2), F.length(F.to_json(F.array("term"))) - 2),
        F.lit(", "), F.col("score").cast("string"), F.lit("]"),
    )
    topics = (
        terms.where(F.col("term") != "")
        .groupBy("system", "topic")
        .agg(F.array_sort(F.collect_list(F.struct("rank", pair.alias("pair")))).alias("pairs"))
        .select(
            "system",
            "topic",
            F.concat(
                F.lit('"'), F.col("topic").cast("string"), F.lit('": ['),
                F.concat_ws(", ", F.transform("pairs", lambda p: p["pair"])), F.lit("]"),
            ).alias("entry"),
        )
    )
    entries = F.array_sort(F.collect_list(F.struct("topic", "entry")))
    return topics.groupBy("system").agg(
        F.concat(
            F.lit("{"), F.concat_ws(", ", F.transform(entries, lambda e: e["entry"])), F.lit("}")
        ).alias("value")
    )


def write_topic_json(terms: DataFrame, path: str) -> None:
    topic_json(terms).write.mode("overwrite").partitionBy("system").text(path)


def write_record(spark: SparkSession, record: Mapping[str, object], path: str) -> None:
    """One row of run parameters or metrics as JSON."""
    spark.createDataFrame([dict(record)]).write.mode("overwrite").json(path)


def fit_or_load(spark: SparkSession, path: str, fit: Callable, load: Callable, digest: str) -> tuple[object, bool]:
    """The model stored at ``path`` for what ``digest`` stands for, else a fresh one that is stored there.

    The digest covers data and parameters, so a model is never reused for others. The flag
    tells whether the model was loaded. Models have ``write(spark, path)``.
    """
    ledger = Ledger(spark, path)

    def make() -> None:
        fit().write(spark, f"{path}/model")

    ledger.stage("model", 1, {}, [digest], make)
    return load(spark, f"{path}/model"), not ledger.made
