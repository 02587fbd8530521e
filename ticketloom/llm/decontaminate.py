"""Benchmark decontamination: a broadcast hash set of the windows of test items.

A window is WINDOW words of an item in a row; an item with fewer words is one window. The
distinct windows go to every task as sorted 64-bit hashes with their words behind them. A task
reads its texts once: words become numbers of the set's own vocabulary (others cut the text),
windows of the text are hashed and found by binary search, and every hit is verified word by
word. Documents keep the spans of their hit words and the items these come from.

The set is broadcast in parts of PART_WINDOWS windows, counted before; a larger benchmark has
more parts, each met by a scan of its own, and the spans of all parts are united by document.

Defined cases: a null text has no words and no hits, nor has one without words. Items without
words have no window. A null item_id counts as empty text; rows that repeat an item_id are one
item. Rows repeated under one doc_id are judged one by one. With no items nothing is hit. Only
the named columns are read, all others of the documents are kept where documents are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.storage import light_batches, stored
from ticketloom.llm.terms import places, words, words_of

WINDOW = 10
PART_WINDOWS = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPANS = "array<struct<start: int, end: int>>"


def windows(benchmark: DataFrame, size: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct rows (item, window) of a benchmark."""
    found = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("_words")
    ).where(F.size("_words") > 0)
    own = F.least(F.size("_words"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("_words") - own + 1)
    return found.select(
        "item", F.explode(F.transform(starts, lambda at: F.slice("_words", at, own))).alias("window")
    ).distinct()


class WindowSet:
    """Windows by length: hashes in order, the words of each and the items it comes from."""

    def __init__(self, table: pa.Table):
        rows = table["window"].to_pylist()
        items = table["item"].to_pylist()
        self.items = sorted(set(items))
        number = {item: i for i, item in enumerate(self.items)}
        self.places: dict[bytes, int] = {}
        for word in chain.from_iterable(rows):
            self.places.setdefault(word.encode(), len(self.places))
        self.by_length = {}
        for size in sorted({len(r) for r in rows}):
            of: dict[tuple, list[int]] = {}
            for row, item in zip(rows, items):
                if len(row) == size:
                    of.setdefault(tuple(self.places[w.encode()] for w in row), []).append(number[item])
            grams = np.array(list(of), np.int64).reshape(len(of), size)
            hashes = rolled(grams.T)
            order = np.argsort(hashes, kind="stable")
            owners = list(of.values())
            ends = np.cumsum([len(owners[i]) for i in order])
            flat = np.array([o for i in order for o in owners[i]], np.int64)
            self.by_length[size] = hashes[order], grams[order], ends, flat


def rolled(columns: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each window; one row of the array for each of its words."""
    found = np.zeros(columns.shape[1], np.uint64)
    for column in columns:
        found = found * _BASE + column.astype(np.uint64) + np.uint64(1)
    return found


def hits(numbers: np.ndarray, held: WindowSet) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
    """For each length: the places where a window of the set starts and which one it is.

    Numbers of words outside the vocabulary are negative, and so is what stands between texts.
    """
    cut = np.concatenate(([0], np.cumsum(numbers < 0)))
    for size, of in held.by_length.items():
        hashes, grams, _, _ = of
        last = len(numbers) - size + 1
        if last <= 0:
            continue
        at = np.flatnonzero(cut[size:] == cut[:last])
        window = np.stack([numbers[at + i] for i in range(size)])
        hashed = rolled(window)
        where = np.searchsorted(hashes, hashed)
        open_ = np.flatnonzero(where < len(hashes))
        starts, which = [], []
        while len(open_):  # further rounds only for windows whose hashes collide
            open_ = open_[hashes[where[open_]] == hashed[open_]]
            same = (grams[where[open_]] == window[:, open_].T).all(axis=1)
            starts.append(at[open_[same]])
            which.append(where[open_[same]])
            open_ = open_[~same]
            where[open_] += 1
            open_ = open_[where[open_] < len(hashes)]
        yield size, np.concatenate(starts or [at[:0]]), np.concatenate(which or [at[:0]]), of


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _found(texts: list, held: WindowSet) -> tuple[list[int], dict[int, list], dict[int, list]]:
    """Word counts, and for texts with hits the spans of hit words and the items."""
    split = [words(t) for t in texts]
    counts = [len(w) for w in split]
    firsts = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))
    between = (None,)
    flat = chain.from_iterable(chain(w, between) for w in split)
    numbers = np.fromiter(map(held.places.get, flat, repeat(-1)), np.int64, int(firsts[-1]))
    deltas = np.zeros(len(numbers) + 1, np.int64)
    items: dict[int, set] = {}
    for size, starts, which, (_, _, ends, owners) in hits(numbers, held):
        np.add.at(deltas, starts, 1)
        np.add.at(deltas, starts + size, -1)
        of = np.searchsorted(firsts, starts, "right") - 1
        for text, window in set(zip(of.tolist(), which.tolist())):
            begin = int(ends[window - 1]) if window else 0
            items.setdefault(text, set()).update(held.items[i] for i in owners[begin : int(ends[window])])
    spans: dict[int, list] = {}
    for start, end in zip(*_runs(np.cumsum(deltas[:-1]) > 0)):
        text = int(np.searchsorted(firsts, start, "right")) - 1
        spans.setdefault(text, []).append({"start": int(start - firsts[text]), "end": int(end - firsts[text])})
    return counts, spans, {text: sorted(found) for text, found in items.items()}


def _scan(docs: DataFrame, held: WindowSet, kind: str, everything: bool) -> DataFrame:
    """doc_id, digest, n_words, spans and items of the rows, or of those with hits only."""
    shared = docs.sparkSession.sparkContext.broadcast(held)
    struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = _found(batch.column(2).to_pylist(), shared.value)
            rows = range(batch.num_rows) if everything else sorted(spans)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    batch.column(1).take(pa.array(rows, pa.int64())),
                    pa.array([counts[r] for r in rows], pa.int64()),
                    pa.array([spans.get(r, []) for r in rows], struct),
                    pa.array([items.get(r, []) for r in rows], pa.list_(pa.string())),
                ],
                names=["doc_id", "digest", "n_words", "spans", "items"],
            )

    return docs.mapInArrow(scan, f"doc_id {kind}, digest binary, n_words long, spans {SPANS}, items array<string>")


def _united(spans: Column) -> Column:
    """Spans of several parts, in order and without overlap."""
    empty = F.array().cast(SPANS)
    grow = lambda done, one: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= one["start"]),
        F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(
                F.struct(
                    F.element_at(done, -1)["start"].alias("start"),
                    F.greatest(F.element_at(done, -1)["end"], one["end"]).alias("end"),
                )
            ),
        ),
    ).otherwise(F.concat(done, F.array(one)))
    return F.when(F.size(spans) > 1, F.aggregate(F.array_sort(spans), empty, grow)).otherwise(spans)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, digest of the text, n_words, spans of hit words and items of every row."""
    spark = docs.sparkSession
    light_batches(spark)
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    text = F.col(text_col).cast("binary")
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit(b"")), 256))
    grams = stored(windows(benchmark, size), "windows")
    parts = max(1, -(-grams.count() // PART_WINDOWS))
    plain = docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), text.alias("text"))
    part = lambda i: WindowSet(grams.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == i).toArrow())
    rows = _scan(plain, part(0), kind, everything=True)
    if parts == 1:
        return rows
    rows = stored(rows, "first-part")
    more = _scan(plain, part(1), kind, everything=False).withColumn("part", F.lit(1))
    for i in range(2, parts):
        more = more.unionByName(_scan(plain, part(i), kind, everything=False).withColumn("part", F.lit(i)))
    # Equal rows give equal spans: one for each part stands for all of them.
    more = (
        more.groupBy("doc_id", "digest", "part").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        .agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    )
    both = rows.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return both.select(
        "doc_id",
        "digest",
        "n_words",
        _united(F.concat("spans", F.coalesce("_spans", F.array().cast(SPANS)))).alias("spans"),
        F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>"))))).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    length = lambda total, span: total + span["end"] - span["start"]
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), length)
    return overlaps(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _cut(text: bytes, spans: list[dict]) -> bytes:
    at, where, kept = 0, places(text), []
    for span in spans:
        kept.append(text[at : where[span["start"]][0]])
        at = where[span["end"] - 1][1]
    return b"".join([*kept, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, spans_only: bool = False) -> DataFrame:
    """The documents, all columns, without those that hold a window, or without its words.

    With ``spans_only`` a document loses the text from the first to the last word of each run
    of hit words and keeps everything else; the columns and other documents stay as they are.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256))
    hit = (
        overlaps(docs, benchmark).where(F.size("spans") > 0)
        .groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        .agg(F.first("spans").alias("_spans"))
    )
    hit = stored(hit, "hit")
    rows = docs.withColumn("_own", digest)
    same = rows["doc_id"].eqNullSafe(hit["_id"]) & (rows["_own"] == hit["_digest"])
    if not spans_only:
        return rows.join(hit, same, "left_anti").drop("_own")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()
            shorter = pa.array([t if s is None else _cut(t, s) for t, s in zip(texts, spans)], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("_text"), "_text", shorter).drop_columns(["_spans"])

    both = rows.join(hit, same, "left").withColumn("_text", F.col("text").cast("binary"))
    others = [c for c in docs.columns if c != "text"]
    wide = both.select(*[rows[c] for c in others], "_text", "_spans")
    schema = wide.drop("_spans").schema
    return wide.mapInArrow(cut, schema).withColumn("text", F.decode("_text", "UTF-8")).select(*docs.columns)
