"""Language-model scores from a weighted automaton with failure arcs.

States are the empty context, words and word pairs. An arc from a state carries the smoothed
log-probability of a next word; a state without the arc follows its failure arc, which carries
the state's backoff weight, to the state of its shorter context, and the empty context has an
arc for every word. Reading a text from left to right, the state after a token is set by the
last two tokens alone.

Probabilities are P(w) = (c + 0.5) / (N + 0.5 (V + 1)) without context and, with D = 0.5,
(c(s, w) - D) / c(s) + weight(s) P(w | shorter s) on an arc. The weight is D times the number
of arcs of s over c(s), so every state sums to one (interpolated absolute discounting).

Counts cover all training texts, and no pair or triple is left out however rare. Texts are cut
into chunks of at most SPAN tokens, which are stored. A chunk sends each of its distinct pairs
and triples once, with its own training count, to the bucket of its state; the bucket adds the
counts of all chunks and answers every chunk, which then holds the part of the automaton that
its texts visit and walks them through it. So a pair or triple in a third of all rows is one
entry a chunk, and a text of any length is walked in chunks that overlap by two tokens. A state
that may hold much of the corpus has its arcs in several buckets, by next word; the counts of
such states (at most SPREAD ** 2 pairs of words) are added up by Spark and sent to all tasks.

Every task also holds the words that make up more than 1 / HEAD of all tokens (at most HEAD).
They go by their place, others by 63 bits of a hash whose seed is changed until no two
training words share one; a word seen in no training text takes the hash of one that is with
probability V / 2^63, and two of M pairs and triples
go by one key with probability M^2 / 2^65.

Defined cases: a null text counts as empty and consists of the end token. Repeated rows are
scored one by one. Without training texts every word has probability one half of one half,
that is 1 of V + 1 = 1, and all scores are 0. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ticketloom.llm.storage import crc_fold, light_batches, stored

HEAD = 1 << 20
DISCOUNT = 0.5
ADDED = 0.5
END = b""
START = -(1 << 63)  # stands before the first word of a text; no word has it
FOLDS, HELD_OUT = 5, 1
FLUSH = 500_000  # distinct words a task counts before it gives them out
SPAN = 1 << 19  # tokens of a chunk
BUCKET = 1 << 20  # tokens for each bucket of states, on average
SPREAD = 1 << 10  # words with a larger share of all tokens than 1 / SPREAD may have divided states


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case and the end token."""
    found = (text or b"").lower().split()
    found.append(END)
    return found


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        words, numbers = list(counts.keys()), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(numbers, pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(tokens(text.as_py()))
            if len(counts) > FLUSH:
                yield out()
    yield out()


class Words:
    """Ids of words: the place of those that are held, a negative hash of the others."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, seed: int):
        self.places = {word: i for i, word in enumerate(words)}
        self.counts = counts
        self.total = total
        self.below = total + ADDED * (distinct + 1)
        self.seed = seed

    def hashed(self, word: bytes) -> int:
        return -1 - xxhash.xxh3_64_intdigest(word, self.seed) % ((1 << 63) - 1)

    def ids(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        for at in np.flatnonzero(found < 0):
            found[at] = self.hashed(words[at])
        return found

    def held(self, ids: np.ndarray) -> np.ndarray:
        """Counts of the held words among these, 0 for others."""
        return np.where(ids >= 0, self.counts[np.maximum(ids, 0)], 0)


def learn_words(training: DataFrame, text_col: str = "text"):
    """Counts of all training words; the held ones and what sets ids, for all tasks."""
    context = training.sparkSession.sparkContext
    texts = training.select(F.col(text_col).cast("binary").alias("text"))
    counts = stored(
        texts.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    often = (F.col("n") * HEAD > total) | (F.col("word") == F.lit(bytearray(END)))
    held = counts.where(often).toArrow().sort_by("word")  # at most HEAD rows and the end, by definition
    names, numbers = held["word"].to_pylist(), held["n"].to_numpy()
    if END not in names:
        names, numbers = [*names, END], np.append(numbers, 0)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.ids(batch.column(0).to_pylist()))], names=["id"])

    for seed in range(64):
        shared = context.broadcast(Words(names, numbers.astype(np.int64), total, distinct, seed))
        if counts.select("word").mapInArrow(hashes, "id long").distinct().count() == distinct:
            return shared
        shared.unpersist()
    raise ValueError("no seed tells all words apart")


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one compressed value, byte by byte of their places."""
    planes = [np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes()
    body = b"".join(planes)
    return head + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def _unpack(blob: bytes) -> list[np.ndarray]:
    many = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes = np.frombuffer(blob, "<i8", many, 8)
    whole = 8 * int(sizes.sum())
    body = pa.decompress(blob[8 * (many + 1) :], decompressed_size=whole, codec="zstd", asbytes=True) if whole else b""
    found, at = [], 0
    for size in sizes.tolist():
        planes = np.frombuffer(body, np.uint8, 8 * size, at).reshape(8, size)
        found.append(np.ascontiguousarray(planes.T).view("<i8").ravel())
        at += 8 * size
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    """Whole numbers spread over 64 bits, one to one."""
    x = x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _cut(texts: DataFrame, shared, kind) -> DataFrame:
    """One row a chunk: its texts' rows (uid, doc_id, held_out) and tokens, as pieces of texts.

    A piece starts with the two tokens before it (skip) and ends with the one behind it
    (ahead), which are read but not scored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        rows, chunks, waiting = 0, 0, 0
        pieces: list[tuple] = []

        def out() -> pa.RecordBatch:
            nonlocal chunks, waiting
            uid, ids, held, skip, ahead, tokens = zip(*pieces)
            words, places = np.unique(np.concatenate(tokens), return_inverse=True)
            sizes = np.array([len(t) for t in tokens])
            blob = _pack(words, places, sizes, np.array(held), np.array(skip), np.array(ahead), np.array(uid))
            row = [[task + chunks], [int(sizes.sum())], [list(ids)], [blob]]
            chunks, waiting = chunks + 1, 0
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["chunk", "size", "ids", "blob"])

        for batch in batches:
            types = [pa.int64(), pa.int64(), pa.list_(batch.schema.field(0).type), pa.binary()]
            for doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = shared.value.ids(tokens(text))
                for start in range(0, len(ids), SPAN):
                    piece = ids[max(0, start - 2) : start + SPAN + 1]
                    if pieces and waiting + len(piece) > SPAN:
                        yield out()
                    pieces.append((task + rows, doc_id, held, min(start, 2), int(start + SPAN < len(ids)), piece))
                    waiting += len(piece)
                rows += 1
        if pieces:
            yield out()

    schema = StructType(
        [StructField("chunk", LongType()), StructField("size", LongType()), StructField("ids", ArrayType(kind))]
    ).add("blob", "binary")
    return stored(texts.mapInArrow(cut, schema), "chunks")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of every distinct key, and for every key the number of its distinct one."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    ordered = keys[order]
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _summed(groups: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    return np.bincount(groups, values, many).astype(np.int64)


def _pair_keys(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return _mix(_mix(first) + last)


def _word_keys(words: np.ndarray) -> np.ndarray:
    return _pair_keys(np.full(len(words), START), words)


class Grams:
    """The distinct pairs and triples of a chunk, and which bucket each belongs to.

    What a bucket is asked is a tree: words, the pairs that begin with each, and the triples
    that begin with each pair. Pairs go by their first word and triples by their first pair;
    where such a state is divided, its arcs are dealt by their last word as well.
    """

    def __init__(self, blob: bytes, own: Words, buckets: int):
        self.words, self.place, sizes, self.held, skip, ahead, self.uid = _unpack(blob)
        place, ids, many = self.place, self.words, len(self.words)
        self.piece = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(place)) - (np.cumsum(sizes) - sizes)[self.piece]
        self.scored = (at >= skip[self.piece]) & (at < (sizes - ahead)[self.piece])
        learnt = self.scored & (self.held[self.piece] == 0)
        self.two, self.three = np.flatnonzero(at >= 1), np.flatnonzero(at >= 2)
        pairs, self.pair = np.unique(place[self.two - 1] * many + place[self.two], return_inverse=True)
        pair_at = np.full(len(place), -1)
        pair_at[self.two] = self.pair
        size = max(len(pairs), 1)
        triples, self.triple = np.unique(pair_at[self.three - 1] * many + place[self.three], return_inverse=True)
        self.first, self.last = pairs // many, pairs % many
        self.state, end = triples // many, triples % many
        self.ends = np.zeros(len(triples), np.int64)  # the pair that a triple ends in
        self.ends[self.triple] = pair_at[self.three]
        self.word_keys = _word_keys(ids)
        self.pair_keys = _pair_keys(ids[self.first], ids[self.last])
        # A state is at most as frequent as the words it consists of.
        counts = own.held(ids)
        spread = min(buckets, SPREAD)
        self.word_parts = 1 + counts * spread // max(own.total, 1)
        self.pair_parts = np.minimum(self.word_parts[self.first], self.word_parts[self.last])
        salts = _mix(ids).view(np.uint64)

        def dealt(keys: np.ndarray, parts: np.ndarray, following: np.ndarray) -> np.ndarray:
            part = salts[following] % parts.astype(np.uint64)
            return (_mix(keys + part.view(np.int64)).view(np.uint64) % np.uint64(buckets)).astype(np.int64)

        home = dealt(self.word_keys[self.first], self.word_parts[self.first], self.last)
        bucket = home[self.state]
        away = np.flatnonzero(self.pair_parts[self.state] > 1)
        bucket[away] = dealt(self.pair_keys[self.state[away]], self.pair_parts[self.state[away]], end[away])
        code = bucket * size + self.state
        entries = np.unique(np.concatenate([home * size + np.arange(len(pairs)), code]))
        self.entry = entries % size  # pairs by bucket, and where a divided one is away also by that
        self.entry_bucket = entries // size
        self.at_home = home[self.entry] == self.entry_bucket
        self.order = np.argsort(code, kind="stable")  # triples by bucket and pair
        starts = np.append(np.searchsorted(code[self.order], entries), len(code))
        self.under = np.diff(starts)
        self.names, cuts = np.unique(self.entry_bucket, return_index=True)
        cuts = np.append(cuts, len(entries))
        self.parts = [(slice(a, b), slice(starts[a], starts[b])) for a, b in zip(cuts[:-1], cuts[1:])]
        self.end_ids = ids[end]
        self.pair_times = _summed(self.pair, learnt[self.two], len(pairs))
        self.triple_times = _summed(self.triple, learnt[self.three], len(triples))

    def runs(self, entries: slice) -> np.ndarray:
        """Where the pairs of a bucket turn to another first word."""
        first = self.first[self.entry[entries]]
        return np.flatnonzero(np.append(True, first[1:] != first[:-1]))

    def question(self, entries: slice, arcs: slice) -> bytes:
        pairs, triples = self.entry[entries], self.order[arcs]
        runs = self.runs(entries)
        heads = self.first[pairs[runs]]
        return _pack(
            self.words[heads],
            np.diff(np.append(runs, len(pairs))),
            self.word_parts[heads] > 1,
            self.words[self.last[pairs]],
            np.where(self.at_home[entries], self.pair_times[pairs], 0),
            self.under[entries],
            self.pair_parts[pairs] > 1,
            self.end_ids[triples],
            self.triple_times[triples],
        )


def _ask(chunks: DataFrame, shared, buckets: int) -> DataFrame:
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(*(c.to_pylist() for c in batch.columns)):
                grams = Grams(blob, shared.value, buckets)
                rows = [grams.question(*part) for part in grams.parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.names), pa.array([chunk] * len(rows), pa.int64()), pa.array(rows, pa.binary())],
                    names=["bucket", "chunk", "blob"],
                )

    return chunks.select("chunk", "blob").mapInArrow(asked, "bucket long, chunk long, blob binary")


_ANSWER = "bucket long, chunk long, blob binary, divided array<struct<state: long, c: long, arcs: long>>"


def _answered(table: pa.Table) -> pa.Table:
    """For every chunk that asked, the counts of its arcs, and count and number of arcs of its states.

    One row without a chunk gives out this bucket's part of divided states.
    """
    asked = [_unpack(blob) for blob in table["blob"].to_pylist()]
    words, pairs_under, words_divided, lasts, pair_times, triples_under, pairs_divided, ends, triple_times = map(
        np.concatenate, zip(*asked)
    )
    word_keys = _word_keys(words)
    _, word = _distinct(word_keys)
    of_pair = np.repeat(word, pairs_under)
    pair_keys = _pair_keys(np.repeat(words, pairs_under), lasts)
    one_pair, pair = _distinct(pair_keys)
    one_triple, triple = _distinct(_mix(np.repeat(pair_keys, triples_under) + ends))
    of_triple = np.repeat(pair, triples_under)
    pair_sums = _summed(pair, pair_times, len(one_pair))
    triple_sums = _summed(triple, triple_times, len(one_triple))
    many = int(word.max()) + 1
    word_counts = _summed(of_pair, pair_times, many)[word]
    word_arcs = _summed(of_pair[one_pair], pair_sums > 0, many)[word]
    pair_counts = _summed(of_triple, triple_times, len(one_pair))[pair]
    pair_arcs = _summed(of_triple[one_triple], triple_sums > 0, len(one_pair))[pair]
    pair_sums, triple_sums = pair_sums[pair], triple_sums[triple]
    answers, at = [], [0, 0, 0]
    for own in asked:
        a, b, c = (slice(start, start + len(own[of])) for start, of in zip(at, (0, 3, 7)))
        answers.append(_pack(word_counts[a], word_arcs[a], pair_sums[b], pair_counts[b], pair_arcs[b], triple_sums[c]))
        at = [a.stop, b.stop, c.stop]
    parts = []
    for keys, divided, counts, arcs in (
        (word_keys, words_divided, word_counts, word_arcs),
        (pair_keys, pairs_divided, pair_counts, pair_arcs),
    ):
        some = np.flatnonzero(divided)
        some = some[_distinct(keys[some])[0]]
        parts += [{"state": k, "c": c, "arcs": n} for k, c, n in zip(keys[some].tolist(), counts[some].tolist(), arcs[some].tolist())]
    entry = pa.list_(pa.struct([("state", pa.int64()), ("c", pa.int64()), ("arcs", pa.int64())]))
    bucket = table["bucket"][0].as_py()
    return pa.table(
        {
            "bucket": pa.array([bucket] * (len(answers) + 1), pa.int64()),
            "chunk": pa.array([*table["chunk"].to_pylist(), None], pa.int64()),
            "blob": pa.array([*answers, None], pa.binary()),
            "divided": pa.array([[]] * len(answers) + [parts], entry),
        }
    )


def _walk(grams: Grams, own: Words, answers: dict[int, bytes], divided: tuple[np.ndarray, ...]):
    """Log-probability of every token of a chunk, without context and by the automaton, and if it is known."""
    words, pairs, triples = len(grams.words), len(grams.first), len(grams.state)
    word_counts, word_arcs = np.zeros(words, np.int64), np.zeros(words, np.int64)
    pair_sums, pair_counts, pair_arcs = (np.zeros(pairs, np.int64) for _ in range(3))
    triple_sums = np.zeros(triples, np.int64)
    for bucket, (entries, arcs) in zip(grams.names.tolist(), grams.parts):
        c1, n1, sums, c2, n2, triple_sums[grams.order[arcs]] = _unpack(answers[bucket])
        mine, home = grams.entry[entries], grams.at_home[entries]
        heads = grams.first[mine[grams.runs(entries)]]
        word_counts[heads], word_arcs[heads] = c1, n1
        pair_sums[mine[home]] = sums[home]
        pair_counts[mine], pair_arcs[mine] = c2, n2
    keys, c, arcs_of = divided
    for own_keys, parts, counts, arcs in (
        (grams.word_keys, grams.word_parts, word_counts, word_arcs),
        (grams.pair_keys, grams.pair_parts, pair_counts, pair_arcs),
    ):
        if len(keys):
            at = np.minimum(np.searchsorted(keys, own_keys), len(keys) - 1)
            whole = (parts > 1) & (keys[at] == own_keys)
            counts[whole], arcs[whole] = c[at[whole]], arcs_of[at[whole]]
    # A word that is not held begins a pair wherever it stands, so the count of its state is its own.
    seen = np.where(grams.words >= 0, own.held(grams.words), word_counts)
    alone = (seen + ADDED) / own.below

    def smoothed(sums: np.ndarray, count: np.ndarray, arcs: np.ndarray, lower: np.ndarray) -> np.ndarray:
        some = np.maximum(count, 1)
        weight = np.where(count > 0, DISCOUNT * arcs / some, 1.0)  # of the failure arc
        return np.maximum(sums - DISCOUNT, 0) / some + weight * lower

    p = alone[grams.place]
    base = np.log10(p)
    by_pair = smoothed(pair_sums, word_counts[grams.first], word_arcs[grams.first], alone[grams.last])
    p[grams.two] = by_pair[grams.pair]
    by_triple = smoothed(triple_sums, pair_counts[grams.state], pair_arcs[grams.state], by_pair[grams.ends])
    p[grams.three] = by_triple[grams.triple]
    return base, np.log10(p), seen[grams.place] > 0


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    light_batches(spark)
    held = crc_fold(F.col(id_col), FOLDS) == HELD_OUT
    shared = learn_words(docs.where(~held), text_col)
    total = shared.value.total
    texts = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    kind = texts.schema["doc_id"].dataType
    chunks = _cut(texts, shared, kind)
    buckets = 1 + (chunks.agg(F.sum("size")).first()[0] or 0) // BUCKET
    answers = stored(_ask(chunks, shared, buckets).groupBy("bucket").applyInArrow(_answered, _ANSWER), "answers")
    parts = answers.where(F.col("chunk").isNull()).select(F.explode("divided").alias("part")).select("part.*")
    # Divided states are words and pairs of words with a share above 1 / SPREAD: at most SPREAD + SPREAD ** 2.
    table = parts.groupBy("state").agg(F.sum("c").alias("c"), F.sum("arcs").alias("arcs")).toArrow().sort_by("state")
    divided = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("state", "c", "arcs")))

    def walked(asked: pa.Table, found: pa.Table) -> pa.Table:
        own, blobs = shared.value, dict(zip(found["bucket"].to_pylist(), found["blob"].to_pylist()))
        grams = Grams(asked["blob"][0].as_py(), own, buckets)
        base, score, known = _walk(grams, own, blobs, divided.value)
        pieces = len(grams.uid)
        sums = [np.bincount(grams.piece[grams.scored], v[grams.scored], pieces) for v in (np.ones(len(base)), known, base, score)]
        tokens, known = (pa.array(s.astype(np.int64)) for s in sums[:2])
        held_out = pa.array(grams.held > 0)
        columns = [pa.array(grams.uid), asked["ids"].combine_chunks().flatten(), held_out, tokens, known, *map(pa.array, sums[2:])]
        return pa.table(columns, names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    schema = StructType([StructField("uid", LongType()), StructField("doc_id", kind)])
    for name, of in [("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")]:
        schema = schema.add(name, of)
    found = answers.where(F.col("chunk").isNotNull()).select("bucket", "chunk", "blob")
    pieces = chunks.select("chunk", "ids", "blob").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(walked, schema)
    rows = pieces.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("held_out").alias("held_out"),
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")),
    )
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )
