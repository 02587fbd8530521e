"""Readers for the tables and artifacts of the ticket jobs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.functions.text import strip
from ticketloom.sources import records


def _header_fields(spark: SparkSession, path: str, separator: str) -> list[str]:
    """Column names of a CSV: only its first line is read."""
    return spark.read.csv(path, sep=separator, header=True, multiLine=True, quote='"', escape='"').columns


def read_tickets(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    separator: str = ",",
    position: str | None = None,
) -> DataFrame:
    """Ticket CSV with header; quoted texts may hold line breaks, and large files are read in parallel.

    Without a schema every column is read as text: types are set by the jobs, and no
    extra pass over the data is spent on guessing them. With ``position`` rows carry their
    number in the order of files and lines, which is what keeping the first row goes by.
    """
    if schema is None:
        fields = _header_fields(spark, path, separator)
        schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = records.without_headers(records.records(spark, path))
    if position is not None:
        rows = records.numbered(rows, position)
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": "true"}
    # Fields by place: a header may repeat a name, which a struct of names would not bear.
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    parsed = rows.withColumn("_fields", F.from_csv("record", plain.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options))
    fields = [F.col(f"_fields.c{i}").alias(f.name) for i, f in enumerate(schema.fields)]
    return parsed.select(*fields, *([position] if position is not None else []))


def read_piped(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Pipe-delimited export."""
    return read_tickets(spark, path, schema, separator="|")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Headerless one-column name list."""
    return spark.read.schema("name string").csv(path, header=False, encoding="UTF-8")


def read_lines(spark: SparkSession, path: str, column: str = "name") -> DataFrame:
    """Text with one item per line; blank lines dropped, the rest trimmed."""
    lines = spark.read.text(path)
    return lines.select(strip(F.col("value")).alias(column)).where(F.col(column) != "")


def read_topic_terms(spark: SparkSession, path: str) -> DataFrame:
    """Topic terms from ``{topic: [[word, score], ...]}`` files, one per system folder.

    Result: ``path, topic, rank, term, score``; entries with an empty word are dropped
    after they were ranked.
    """
    whole = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )
    topics = whole.select(
        "path", F.explode(F.from_json("value", "map<string,array<array<string>>>"))
    )
    terms = topics.select("path", F.col("key").cast("int").alias("topic"), F.posexplode("value"))
    return terms.select(
        "path",
        "topic",
        (F.col("pos") + 1).alias("rank"),
        F.col("col")[0].alias("term"),
        F.col("col")[1].cast("double").alias("score"),
    ).where(F.col("term") != "")


def read_topic_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of the readable export of topics: ``system, topic, value``, headings included.

    A system's file holds a few topics of a few words each and is read as a whole.
    """
    whole = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/system=([^/]+)/", 1).alias("system"), "value"
    )
    blocks = F.regexp_extract_all("value", F.lit(r"\ntopico -?\d+:\n[^\n]*"), F.lit(0))
    return whole.select("system", F.explode(blocks).alias("value")).select(
        "system", F.regexp_extract("value", r"topico (-?\d+):", 1).cast("int").alias("topic"), "value"
    )


def read_topic_texts(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """One text per topic from ``<system>/<prefix><topic>.txt`` files; no files, no rows.

    Joined to the topics from the left, a topic without a file so gets a null text.
    """
    file_path = F.col("_metadata.file_path")
    try:
        files = spark.read.text(f"{path}/*/{prefix}*.txt", wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "system string, topic int, text string")
    return files.select(
        F.regexp_extract(file_path, r"([^/]+)/[^/]+$", 1).alias("system"),
        F.regexp_extract(file_path, rf"{prefix}(-?\d+)\.txt$", 1).cast("int").alias("topic"),
        strip(F.col("value")).alias("text"),
    )


def read_vectors(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """Stored embeddings by id: vectors never depend on row order."""
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), "embedding")


def read_if_present(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or an empty one of the same schema when it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything was written at ``path``, on whatever file system it lies."""
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True
