"""URL rules looked up in a sorted array of digests.

Rules are sorted by the 64-bit xxHash of ``host + path`` and cut into shards of key ranges,
each written by one task to the shared folder. Spark ships the shard files to the executors,
where a worker unpacks them once and maps the key array into memory. A batch of URLs probes
all its candidate strings (host suffixes times the path lengths that rules have) with one
vectorised binary search, and a hit counts only if the stored string is the candidate itself.

Defined cases: a URL that is null or has no ``://`` has an empty host and path. A rule fits
its host and all subdomains of it when the path starts with the rule's. The longest fitting
rule string wins, among equals the one with the longer host. No fitting rule: ``allow``, since
a digest list blocks only what it holds. Rules with a null host count as an empty host; of
rules with the same string a block goes before an allow. Repeated rows are judged alike, and
an empty table or an empty rule list is fine.
"""

from __future__ import annotations

import functools
import mmap
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm.storage import shared_path

SHARD_RULES = 1_000_000
RULES = "rule string, host_length int, path_length int, verdict string"
SHARD = "keys binary, ends binary, strings binary, host_lengths binary, path_lengths binary, allows binary"
ORDERED = 1 << 63  # moves unsigned keys to the order of signed ones, in which Spark sorts
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; nothing without it."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [xxhash.xxh64_intdigest(rule) - ORDERED for rule in batch.column(0).to_pylist()]
        yield batch.append_column("key", pa.array(digests, pa.int64()))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: the arrays of its rules, which arrive in key order."""
    received = list(batches)
    table = pa.Table.from_batches(received) if received else None
    if table is None or not table.num_rows:
        return
    rules = [rule.encode() for rule in table["rule"].to_pylist()]
    numbers = lambda name, kind: table[name].to_numpy().astype(kind).tobytes()
    yield pa.RecordBatch.from_pydict(
        {
            "keys": [numbers("key", np.int64)],
            "ends": [np.cumsum([len(r) for r in rules], dtype=np.int64).tobytes()],
            "strings": [b"".join(rules)],
            "host_lengths": [numbers("host_length", np.int32)],
            "path_lengths": [numbers("path_length", np.int32)],
            "allows": [np.array([v == "allow" for v in table["verdict"].to_pylist()], np.uint8).tobytes()],
        }
    )


def write_digest(rules: DataFrame) -> list[str]:
    """Write the shards of a rule table (host, path, verdict); the files' paths."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, UPPER.lower())
    path = F.coalesce("path", F.lit(""))
    # Both parts' lengths are kept: the string alone does not tell where the host ends.
    unique = (
        rules.groupBy(
            F.concat(host, path).alias("rule"),
            F.length(host).alias("host_length"),
            F.length(path).alias("path_length"),
        )
        .agg(F.max("verdict").alias("verdict"))  # "block" comes after "allow"
    )
    keyed = unique.mapInArrow(_hashed, f"{RULES}, key long")
    shards = -(-max(1, unique.count()) // SHARD_RULES)
    ordered = keyed.repartitionByRange(shards, "key").sortWithinPartitions("key", "rule", "host_length")
    folder = shared_path(rules.sparkSession, "digest")
    ordered.mapInArrow(_shards, SHARD).write.parquet(folder)
    return list(rules.sparkSession.read.schema(SHARD).parquet(folder).inputFiles())


class Shard:
    """One key range, its arrays mapped from a file on the executor's own disk."""

    def __init__(self, file: str):
        columns = pq.read_table(file).to_pylist()
        parts = [row[name] for row in columns for name in SHARD.replace(" binary", "").split(", ")]
        with tempfile.TemporaryFile() as unpacked:
            places = []
            for part in parts:
                unpacked.write(b"\0" * (-unpacked.tell() % 8))
                places.append((unpacked.tell(), len(part)))
                unpacked.write(part)
            unpacked.write(b"\0")
            unpacked.flush()
            mapped = mmap.mmap(unpacked.fileno(), 0, access=mmap.ACCESS_READ)
        view = [np.frombuffer(mapped, np.uint8, size, at) for at, size in places] or [np.zeros(0, np.uint8)] * 6
        self.keys, self.ends = view[0].view(np.int64), view[1].view(np.int64)
        self.strings = view[2]
        self.host_lengths, self.path_lengths = view[3].view(np.int32), view[4].view(np.int32)
        self.allows = view[5]
        self.paths = np.unique(self.path_lengths)

    def string(self, at: int) -> bytes:
        return self.strings[self.ends[at - 1] if at else 0 : self.ends[at]].tobytes()

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each key."""
        return np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")


@functools.cache
def _opened(names: tuple[str, ...]) -> list[Shard]:
    return [Shard(SparkFiles.get(name)) for name in names]


def suffixes(host: str, longest: int) -> list[str]:
    """The host and its parents, those no longer than the longest host of a rule."""
    found = [host] if len(host) <= longest else []
    at = host.find(".", max(0, len(host) - longest - 1))
    while at >= 0:
        found.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return found


def _best_rules(hosts: list[str], paths: list[str], shards: list[Shard]) -> list[tuple | None]:
    """(length, host length, rule, allow) of the winner for each URL."""
    lengths = sorted({int(n) for shard in shards for n in shard.paths})
    longest = max((int(shard.host_lengths.max()) for shard in shards if len(shard.host_lengths)), default=0)
    owner, strings, split = [], [], []
    for row, (host, path) in enumerate(zip(hosts, paths)):
        for suffix in suffixes(host, longest):
            for length in lengths:
                if length <= len(path):
                    owner.append(row)
                    strings.append(suffix + path[:length])
                    split.append(len(suffix))
    best: list[tuple | None] = [None] * len(hosts)
    keys = np.array([xxhash.xxh64_intdigest(s) - ORDERED for s in strings], np.int64)
    for shard in shards:
        first, last = shard.probe(keys)
        for i in np.flatnonzero(last > first):
            text = strings[i].encode()
            for at in range(first[i], last[i]):
                if shard.host_lengths[at] == split[i] and shard.string(at) == text:
                    found = (len(strings[i]), split[i], strings[i], bool(shard.allows[at]))
                    row = owner[i]
                    if best[row] is None or found[:2] > best[row][:2]:
                        best[row] = found
    return best


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    spark: SparkSession = pages.sparkSession
    files = write_digest(rules)
    for file in files:
        spark.sparkContext.addFile(file)
    names = tuple(file.rpartition("/")[2] for file in files)
    parts = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _opened(names)
        for batch in batches:
            best = _best_rules(batch.column(1).to_pylist(), batch.column(2).to_pylist(), shards)
            yield batch.append_column(
                "rule", pa.array([b and b[2] for b in best], pa.string())
            ).append_column(
                "verdict", pa.array(["allow" if b is None or b[3] else "block" for b in best], pa.string())
            )

    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string")
