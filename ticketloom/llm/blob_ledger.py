"""Secret scans with an incremental ledger of content-addressed blobs.

A document is a path, its text a blob named by its SHA-256. The ledger, a Parquet folder,
holds the findings of every (blob, rule version) pair scanned so far. A run works out the
pairs it has not seen, moves only those texts, one for each blob, scans them, appends the
findings, and joins the ledger back to all paths, however many share a blob.

Kinds of findings, leftmost and without overlap within a kind: ``assign`` (a name such as
``password``, a separator and a value of six or more characters), ``access`` (``AKIA`` and
capitals or digits, twenty or more characters), ``hex`` (24 or more hexadecimal digits). A
match that fails its length test is dropped and the search goes on behind it. Starts and
ends count code points, ends are exclusive and spans cover the whole match.

Defined cases: a null text is an empty blob without findings; a null id is a path like any
other; repeated rows each get the findings of their text; an empty table gives an empty
result and leaves the ledger as it is. A pair that was appended twice, by a repeated row or
after a lost driver, does no harm, since the ledger is read once for each pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm.storage import light_batches, shared_path, stored
from ticketloom.operators.scale import salted_join

# What is asked for.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
NAMES = ("password", "passwd", "secret", "token", "api")

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)
VERSION = hashlib.sha256("\n".join((ASSIGN, ACCESS, HEX, str(ASSIGN_LENGTH), str(ACCESS_LENGTH))).encode()).hexdigest()[:16]

FINDINGS = "array<struct<kind: int, start: long, end: long>>"
LEDGER = f"blob binary, version string, findings {FINDINGS}"


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all findings, by start and then kind."""
    found = []
    lower = text.lower()
    if any(name in lower for name in NAMES):
        found += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    # A run that is too short holds no shorter run that is long enough.
    found += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], f[0]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        findings = [
            [dict(zip(("kind", "start", "end"), f)) for f in find(text)] for text in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([VERSION] * batch.num_rows, pa.string()), pa.array(findings, kind)],
            names=["blob", "version", "findings"],
        )


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """Findings by blob of the present rule version; no rows before the first scan."""
    try:
        rows = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], LEDGER)
    return rows.where(F.col("version") == VERSION).groupBy("blob").agg(F.first("findings").alias("findings"))


def scan(
    docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, blob and findings of every row; ``ledger`` is the folder that lasts between runs."""
    spark = docs.sparkSession
    light_batches(spark)
    ledger = ledger or shared_path(spark, "ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("blob"))
    blobs = stored(
        paths.groupBy("blob").agg(F.min("doc_id").alias("path"), F.count(F.lit(1)).alias("copies")), "blobs"
    )
    unseen = stored(blobs.join(read_ledger(spark, ledger), "blob", "left_anti").select("blob", "path"), "unseen")
    # Planned by the stored size: a small increment is broadcast and the texts stay in place.
    texts = docs.select(
        F.col(id_col).alias("own"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    todo = texts.join(
        unseen, F.col("own").eqNullSafe(F.col("path")) & (F.col("digest") == F.col("blob"))
    ).select("blob", "text")
    todo.mapInArrow(_scanned, LEDGER).write.mode("append").parquet(ledger)
    found = blobs.join(read_ledger(spark, ledger), "blob").select("blob", "findings", "copies")
    return salted_join(paths, found, ["blob"], "copies", ["doc_id"])


def rendered(findings: Column) -> Column:
    """``kind:start:end`` of each finding, joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", F.get(names, f["kind"]), f["start"], f["end"])), ","
    )


def of_kind(findings: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(findings, lambda f: f["kind"] == number)).cast("long")
