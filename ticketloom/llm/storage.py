"""Intermediate tables in the folder that the cluster names, and what reads need in common."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 * 1024 * 1024
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = "67108864b"
_WRITTEN: dict[str, list[str]] = {}


def light_batches(spark: SparkSession) -> None:
    """Let whole texts reach Python in batches of BATCH_BYTES; a session's own limit stays.

    Rows are counted in thousands by default, whatever their length, and every batch is held
    by the executor, on the way and in Python, beside a heap that is full anyway. A text that
    is longer than a batch is one by itself.
    """
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing the job must not guess on a cluster; a local session,
    as in tests, gets a folder below its own warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    path = f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once as Parquet and read back, which cuts its lineage.

    A lost executor costs nothing that was stored before, a table that several branches
    read is computed once, and Spark plans the joins behind it by its true size.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove the intermediate tables of this session, once its results are written."""
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)


def crc_fold(key: Column, folds: int) -> Column:
    """Fold of a row by the CRC-32 of its id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
