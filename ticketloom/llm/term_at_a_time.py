"""Ranked lexical search, term at a time, with a limit on new accumulators.

Documents are read once into blocks of postings of the terms that are asked for: for each term
the places and counts of the documents that hold it, and the lengths of those documents. Blocks
are rows of a stored table; the number of documents, words and of documents by term are sums
over them. A task ranks its blocks for every item: it takes the item's terms from the rarest
on and adds their weights to one accumulator for each document. Once the bounds of the terms
left, together, are below the k-th partial score, no document without an accumulator can get
among the first k: from then on only those that have one are looked up in the postings, and
they are scored exactly. The k-th score carries on from block to block. Scores of one block in
SEED_BLOCKS are ranked first; their k-th is a bound for all tasks, which keeps what tasks give
out near k rows for an item, however many tasks there are.

Items are asked in parts of PART_PAIRS pairs of item and term, counted before, so what a task
holds of them is bounded; each part reads the documents once.

Defined cases: documents without terms (null or empty text) are not counted and never found.
Rows repeated under one doc_id are documents of their own. Rows that repeat an item_id are one
item with the terms of all; items without terms give no rows, a null item_id is an item as any
other. Equal scores stand by doc_id, null first. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.storage import light_batches, stored
from ticketloom.llm.terms import words, words_of

K = 10
PART_PAIRS = 500_000
BLOCK_POSTINGS = 1 << 19
SEED_BLOCKS = 16
_LISTS = ("lengths", "terms", "ends", "places", "times")


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct pairs (item_id, term)."""
    found = items.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("_terms"))
    return found.select("item_id", F.explode("_terms").alias("term")).distinct()


class _Block:
    """Postings of documents read so far, not yet given out."""

    def __init__(self, kind: pa.DataType, n_terms: int):
        self.kind, self.n_terms = kind, n_terms
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.codes, self.places, self.times = [], [], [], [], []
        self.held = self.size = self.documents = self.words = 0

    def add(self, ids: pa.Array, lengths: np.ndarray, codes: np.ndarray) -> None:
        self.documents += int((lengths > 0).sum())
        self.words += int(lengths.sum())
        row = np.repeat(np.arange(len(lengths)), lengths)
        asked = codes >= 0
        pairs, times = np.unique(row[asked] * self.n_terms + codes[asked], return_counts=True)
        row, code = np.divmod(pairs, self.n_terms)
        rows, place = np.unique(row, return_inverse=True)
        self.ids.append(ids.take(pa.array(rows)))
        self.lengths.append(lengths[rows])
        self.codes.append(code)
        self.places.append(place + self.held)
        self.times.append(times)
        self.held += len(rows)
        self.size += len(pairs)

    def out(self) -> pa.RecordBatch:
        code, place, times = (np.concatenate(a) if a else np.zeros(0, int) for a in (self.codes, self.places, self.times))
        order = np.argsort(code, kind="stable")
        terms, first = np.unique(code[order], return_index=True)
        ends = np.append(first[1:], len(code)) if len(terms) else first
        lists = (np.concatenate(self.lengths) if self.lengths else np.zeros(0, int), terms, ends, place[order], times[order])
        ids = pa.concat_arrays(self.ids) if self.ids else pa.array([], self.kind)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                *[pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, pa.int32())) for a in lists],
                pa.array([self.documents], pa.int64()),
                pa.array([self.words], pa.int64()),
            ],
            names=["ids", *_LISTS, "documents", "words"],
        )
        self.clear()
        return batch


def blocks(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of the terms of the vocabulary over all documents, stored, one block a row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = shared.value, None
        for batch in batches:
            block = block or _Block(batch.schema.field(0).type, len(known))
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                split = [words(t) for t in part.column(1).to_pylist()]
                lengths = np.fromiter(map(len, split), np.int64, len(split))
                flat = chain.from_iterable(split)
                codes = np.fromiter(map(known.get, flat, repeat(-1)), np.int64, int(lengths.sum()))
                block.add(part.column(0), lengths, codes)
                if block.size >= BLOCK_POSTINGS:
                    yield block.out()
        if block is not None and block.words:
            yield block.out()

    lists = ", ".join(f"{name} array<int>" for name in _LISTS)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return stored(texts.mapInArrow(read, f"ids array<{kind}>, {lists}, documents long, words long"), "postings")


def _order(pair: tuple) -> tuple:
    score, doc = pair
    return -score, doc is not None, doc


class Search:
    """Items of a part with their terms from the rarest on, and the scores any result must reach."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, documents: int, total: int, k: int):
        self.items, self.weights, self.documents, self.total, self.k = items, weights, documents, total, k
        self.bounds = [0] * len(items)

    def block(self, row: dict, best: list[list[tuple]]) -> None:
        """Brings the best of every item, (score, document), up to date with one block."""
        lengths, terms, ends, places, times = (row[name] for name in _LISTS)
        norm = 8 * (10 + (90 * lengths * self.documents) // self.total)
        begins = np.concatenate(([0], ends[:-1]))
        slices = dict(zip(terms.tolist(), zip(begins.tolist(), ends.tolist())))
        ready: dict[int, tuple] = {}

        def postings(code: int) -> tuple[np.ndarray, np.ndarray, int]:
            if code not in ready:
                begin, end = slices[code]
                own, n = places[begin:end], times[begin:end]
                impact = self.weights[code] * ((1_000_000_000 * n) // (1000 * n + norm[own]))
                ready[code] = own, impact, int(impact.max())
            return ready[code]

        for item, codes in enumerate(self.items):
            lists = [postings(c) for c in codes if c in slices]
            if lists:
                self._item(lists, len(lengths), row["ids"], item, best)

    def _item(self, lists: list[tuple], n: int, ids: list, item: int, best: list[list[tuple]]) -> None:
        found = best[item]
        least = max(self.bounds[item], found[-1][0] if len(found) == self.k else 0, 1)
        left = sum(most for _, _, most in lists)
        sums = np.zeros(n, np.int64)
        survivors, kth = None, least
        for own, impact, most in lists:
            if survivors is None and left < kth:
                survivors = np.flatnonzero(sums)
            if survivors is None:
                sums[own] += impact
                if n >= self.k:
                    kth = max(kth, int(np.partition(sums, n - self.k)[n - self.k]))
            else:
                at = np.searchsorted(own, survivors)
                at[at == len(own)] = 0
                both = own[at] == survivors
                sums[survivors[both]] += impact[at[both]]
            left -= most
        if n >= self.k:
            least = max(least, int(np.partition(sums, n - self.k)[n - self.k]))
        reached = np.flatnonzero(sums >= least)
        if len(reached):
            candidates = chain(found, zip(sums[reached].tolist(), (ids[i] for i in reached.tolist())))
            best[item] = heapq.nsmallest(self.k, candidates, key=_order)


def _ranked(table: DataFrame, search: Search, item_ids: pa.Array, item_kind: str, kind: str) -> DataFrame:
    """The best documents of each item by task, (item_id, item, doc_id, score)."""
    shared = table.sparkSession.sparkContext.broadcast((search, item_ids))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = shared.value
        best: list[list[tuple]] = [[] for _ in own.items]
        kind_of = None
        for batch in batches:
            kind_of = batch.schema.field(0).type.value_type
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].values.to_numpy().astype(np.int64) for name in _LISTS}
                row["ids"] = batch.column("ids")[at].values.to_pylist()
                if len(row["lengths"]):
                    own.block(row, best)
        flat = [(item, doc, score) for item, found in enumerate(best) for score, doc in found]
        if flat:
            item, doc, score = zip(*flat)
            numbers = pa.array(item, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [names.take(numbers), numbers, pa.array(doc, kind_of), pa.array(score, pa.int64())],
                names=["item_id", "item", "doc_id", "score"],
            )

    return table.select("ids", *_LISTS).mapInArrow(rank, f"item_id {item_kind}, item int, doc_id {kind}, score long")


def _first(ranked: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return ranked.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _part(docs: DataFrame, pairs: pa.Table, item_kind: str, k: int, id_col: str, text_col: str) -> DataFrame:
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    terms = pairs["term"].unique().to_pylist()
    vocabulary = {term.encode(): i for i, term in enumerate(terms)}
    table = blocks(docs, vocabulary, id_col, text_col)
    documents, total = table.agg(F.sum("documents"), F.sum("words")).first()
    documents, total = documents or 0, max(total or 0, 1)
    counts = np.zeros(len(terms), np.int64)
    sizes = F.transform("ends", lambda end, i: end - F.when(i > 0, F.get("ends", i - 1)).otherwise(0))
    each = table.select(F.explode(F.arrays_zip("terms", sizes.alias("n"))).alias("of"))
    for row in each.groupBy("of.terms").agg(F.sum("of.n").alias("n")).toArrow().to_pylist():  # one row a term of the part
        counts[row["terms"]] = row["n"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in counts.tolist()], np.int64)
    by_item: dict = {}
    for item, term in zip(pairs["item_id"].to_pylist(), pairs["term"].to_pylist()):
        by_item.setdefault(item, []).append(vocabulary[term.encode()])
    items = [sorted(codes, key=lambda c: (counts[c], c)) for codes in by_item.values()]
    names = pa.array(list(by_item), pairs.schema.field("item_id").type)
    search = Search(items, weights, documents, total, k)
    seed = table.where(F.pmod(F.xxhash64("documents", "words", F.get("ids", F.lit(0))), F.lit(SEED_BLOCKS)) == 0)
    kth = _first(_ranked(seed, search, names, item_kind, kind), k).where(F.col("rank") == k)
    for row in kth.select("item", "score").toArrow().to_pylist():  # at most one row an item of the part
        search.bounds[row["item"]] = row["score"]
    return _first(_ranked(table, search, names, item_kind, kind), k).select("item_id", "rank", "doc_id", "score")


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item."""
    spark = docs.sparkSession
    light_batches(spark)
    pairs = stored(item_terms(items, item_col, item_text_col), "asked")
    item_kind = dict(pairs.dtypes)["item_id"]
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    count = pairs.count()
    found = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    parts = -(-count // PART_PAIRS)
    for i in range(parts):
        part = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).toArrow()
        if part.num_rows:
            ranked = _part(docs, part, item_kind, k, id_col, text_col)
            found = ranked if parts == 1 else found.unionByName(ranked)
    return found
