"""Tables that grow by runs: a run adds its rows once, whole or not at all.

Rows are staged below ``data/run=<run>`` and count from the moment the commit below
``commits/<run>`` is there, which is written last and never replaced. A job that is repeated
under its run id adds nothing; what a broken one staged is never read and is replaced when the
run is repeated. Readers follow the commits, one small record a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.sources.readers import exists

_COMMIT = "run string, number long"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``run, number`` of all runs that were committed; numbers rise."""
    if not exists(spark, f"{path}/commits/*"):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).json(f"{path}/commits/*")


def append_once(df: DataFrame, path: str, run: str) -> bool:
    """Adds the rows under a run id; False, and nothing done, if that run is committed."""
    spark = df.sparkSession
    done = {r["run"]: r["number"] for r in commits(spark, path).collect()}  # one record a run
    if run in done:
        return False
    df.write.mode("overwrite").parquet(f"{path}/data/run={run}")
    record = spark.createDataFrame([(run, max(done.values(), default=0) + 1)], _COMMIT)
    record.coalesce(1).write.mode("errorifexists").json(f"{path}/commits/{run}")
    return True


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed runs with ``run`` and its ``number``; none before the first."""
    done = [(r["run"], r["number"]) for r in commits(spark, path).collect()]
    if not done:
        return spark.createDataFrame([], f"{schema}, run string, number long")
    folders = [f"{path}/data/run={run}" for run, _ in done]
    rows = spark.read.option("basePath", f"{path}/data").schema(f"{schema}, run string").parquet(*folders)
    return rows.join(F.broadcast(spark.createDataFrame(done, _COMMIT)), "run").select(*rows.columns, "number")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows of one key those of the newest run; the columns of runs are dropped.

    Newest first by an aggregate that shrinks on the map side, so a key with rows in very many
    runs never meets in one task.
    """
    newest = rows.groupBy(*keys).agg(F.max("number").alias("_newest"))
    same = [rows[k].eqNullSafe(newest[k]) for k in keys] + [rows["number"] == newest["_newest"]]
    return rows.join(newest, same, "left_semi").drop("run", "number")
