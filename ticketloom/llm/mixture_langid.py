"""Language identification as inference in a mixture of languages.

Every language is a distribution over hashed character trigrams, counted over all training
texts. A document is a mixture of languages; expectation-maximisation finds the proportions
that make its trigrams most likely, and the set of languages is the one with the best
likelihood less a penalty for every further language. The answer is the language with the
largest share of the mixture and, as score, that share.

Defined cases: a null text and a text without any letter are ``und`` with score 0, and so is
everything when nothing could be learned. Ties go to the language that is first by code
point. Training leaves out rows with a null language or a null text. Only the named columns
are read. The model holds BINS numbers a language, and there may be MAX_LANGUAGES of them,
which bounds what is collected and broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.storage import crc_fold, light_batches

BINS = 1 << 15
MAX_LANGUAGES = 512
TOLERANCE = 1e-4  # of a share, at which EM has settled
SMOOTHING = 0.1
PENALTY = 4.0  # times the log of the number of trigrams, for each further language
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2


@functools.cache
def _letters() -> np.ndarray:
    """For each code point itself if a letter, else a space."""
    points = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    points[~letter] = 32
    return points


def trigrams(text: str) -> np.ndarray:
    """Bins of the trigrams of a text in lower case, everything but letters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _letters()[np.minimum(points, 0x10FFFF)]
    blank = points == 32
    if not len(points) or blank.all():
        return np.zeros(0, np.int64)
    points = np.concatenate(([32], points[~(blank & np.roll(blank, 1))], [32])).astype(np.uint64)
    mixed = (points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed + points[2:]) * np.uint64(0x165667B19E3779F9)
    return (mixed >> np.uint64(49)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and bin of all texts of a task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            table = counts.setdefault(lang, np.zeros(BINS, np.int64))
            np.add.at(table, trigrams(text), 1)
    for lang, table in counts.items():
        bins = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang] * len(bins), pa.string()),
                "bin": pa.array(bins, pa.int32()),
                "n": pa.array(table[bins], pa.int64()),
            }
        )


class Model:
    """Logarithms of smoothed trigram probabilities, one row for each bin."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smoothed = counts + SMOOTHING
        self.logs = np.ascontiguousarray(np.log(smoothed / smoothed.sum(1, keepdims=True)).T, np.float32)


def learn(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    light_batches(training.sparkSession)
    rows = training.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counted = (
        rows.mapInArrow(_counted, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    )
    limit = MAX_LANGUAGES * BINS
    table = counted.limit(limit + 1).toPandas()
    languages = sorted(table["lang"].unique())
    if len(table) > limit or len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), BINS))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[table["lang"].map(place).to_numpy(np.int64), table["bin"].to_numpy()] = table["n"]
    return Model(languages, counts)


def _mixture(likely: np.ndarray, weights: np.ndarray | None, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions once a step of EM moves none by more than TOLERANCE, and their log-likelihood."""
    shares, total = start, len(likely) if weights is None else weights.sum()
    while True:
        of_all = likely @ shares
        given = 1.0 / of_all if weights is None else weights / of_all
        moved = shares * (given @ likely) / total
        still = np.abs(moved - shares).max() <= TOLERANCE
        shares = moved
        if still:
            break
    logs = np.log(likely @ shares)
    return shares, float(logs.sum() if weights is None else weights @ logs)


def mixture(text: str | None, model: Model) -> list[tuple[str, float]]:
    """The languages of a text with their shares, the largest first; none without a letter.

    Every learned language takes part. The set is grown in the order of the shares that all
    languages get together, as long as a further one gains more than its price.
    """
    bins = trigrams(text) if text else np.zeros(0, np.int64)
    if not len(bins) or not model.languages:
        return []
    weights = None
    if len(bins) > BINS:  # long texts by distinct trigrams, so that memory stays bounded
        counts = np.bincount(bins, minlength=BINS)
        bins = np.flatnonzero(counts)
        weights = counts[bins].astype(np.float64)
    logs = model.logs[bins]
    alone = logs.sum(0, dtype=np.float64) if weights is None else weights @ logs
    first = int(alone.argmax())
    peak = logs.max(1)
    likely = np.exp(logs - peak[:, None]).astype(np.float64)
    base = float(peak.sum(dtype=np.float64) if weights is None else weights @ peak)
    count = len(bins) if weights is None else weights.sum()
    price = PENALTY * np.log(count + 1)
    chosen, shares, score = [first], np.ones(1), alone[first]
    full, most = _mixture(likely, weights, np.full(len(alone), 1 / len(alone)))
    order = [first, *(i for i in np.argsort(-full, kind="stable").tolist() if i != first)]
    for k in range(2, len(order) + 1):
        # No set gains more over one language than all languages together do.
        if base + most - alone[first] <= price:
            break
        these = order[:k]
        start = np.maximum(full[these], TOLERANCE)
        found, logged = _mixture(likely[:, these], weights, start / start.sum())
        if base + logged - price * (k - 1) <= score:
            break
        chosen, shares, score = these, found, base + logged - price * (k - 1)
    ranked = sorted(zip(shares, chosen), key=lambda p: (-round(p[0], 12), p[1]))
    return [(model.languages[i], float(min(1.0, share))) for share, i in ranked]


def infer(text: str | None, model: Model) -> tuple[str, float]:
    """The main language of a text and its share."""
    found = mixture(text, model)
    return found[0] if found else (UNKNOWN, 0.0)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the other fold.

    ``languages`` and ``proportions`` are the chosen set, the largest share first.
    """
    held = held_out(F.col(id_col))
    model = learn(docs.where(~held), text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [mixture(text, known) for text in batch.column(2).to_pylist()]
            main = [f[0] if f else (UNKNOWN, 0.0) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([lang for lang, _ in main], pa.string()),
                    pa.array([share for _, share in main], pa.float64()),
                    pa.array([[lang for lang, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([[share for _, share in f] for f in found], pa.list_(pa.float64())),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>")


def held_out(key: Column) -> Column:
    return crc_fold(key, FOLDS) == HELD_OUT


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a language: texts that are null or hold no letter go.

    The prediction is carried beside the row, so the texts are not shuffled.
    """
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [infer(text, known)[0] != UNKNOWN for text in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
