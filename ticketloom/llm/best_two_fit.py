"""Packing documents into sequences by best-two-fit.

Every document becomes token ids and an end id, cut only where it is longer than a sequence.
Pieces are dealt by hash into groups of bounded size, each packed by one task: a bin is
filled greedily with the longest piece that still fits; then its smallest piece gives way to
two unpacked pieces if those fill the gap so made more tightly. A group leaves at most its
last bins part full, so thousands of bins share that loss.

The tokenizer works on one word at a time here, words being what ASCII white space parts:
its normaliser never joins letters over white space and its patterns never cross it, so the
ids of a text are those of its words in a row. A worker encodes a word once while it
remembers it.

Defined cases: a null or empty text is the end id alone. Rows repeated under one id are
packed like others: equal pieces are counted and then dealt by their number, so that they
do not meet in one group. Empty tables give an empty result. A word of any length is encoded whole.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.storage import light_batches, stored

CAPACITY = 4096
END = struct.pack("<I", 1)
WIDTH = len(END)  # bytes of an id
GROUP_PIECES = 65_536  # pieces a task packs, on average
EQUAL_BLOCK = 4_096  # equal pieces numbered at once
KNOWN_WORDS = 500_000  # words of a generation, about 100 MB
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = "piece int, start long, length long, ids_crc32 long"


class Words(dict):
    """Ids of a word as little-endian bytes; encodes a word when it is first asked for.

    Words of two generations are remembered, so that frequent ones outlast the rare. A word of
    plain letters goes through the normaliser and the patterns as one lower-case token, so it
    is handed to the model directly, if the tokenizer is found to treat it so.
    """

    PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,]*)\Z")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        self.older: dict[bytes, bytes] = {}
        self.direct = False
        letters = [chr(c) for c in range(0x61, 0x100) if self.PLAIN.match(chr(c)) and chr(c).islower()]
        written = {c: self.encoder.pre_tokenizer.pre_tokenize_str(c) for c in letters}
        self.alphabet = str.maketrans({c: parts[0][0] for c, parts in written.items() if parts})
        probes = [a + b for a in letters for b in letters] + ["The", "ÉCOLE", "Straße.", "naïve,", "Ñ.,"]
        self.direct = all(self.plain(w) == self.whole(w) for w in probes)

    def whole(self, word: str) -> bytes:
        return np.array(self.encoder.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, word: str) -> bytes | None:
        parts = self.PLAIN.match(word)
        if not parts:
            return None
        ids = [token.id for token in self.model.tokenize(parts[1].lower().translate(self.alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids) + (self[parts[2].encode()] if parts[2] else b"")

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode()
            ids = (self.plain(text) if self.direct else None) or self.whole(text)
        if len(self) >= KNOWN_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """The ids of a text and the end id."""
        return b"".join(map(self.__getitem__, text.split())) + END


@functools.cache
def _words(path: str) -> Words:
    return Words(path)


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = words.ids(text or b"")
                for piece, start in enumerate(range(0, len(ids) // WIDTH, CAPACITY)):
                    part = ids[start * WIDTH : (start + CAPACITY) * WIDTH]
                    rows.append((row, piece, start, len(part) // WIDTH, zlib.crc32(part)))
            at, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    light_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(pieces, f"doc_id {dict(rows.dtypes)['doc_id']}, {PIECES}")


def fill(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    left: dict[int, list[int]] = {}
    for at in np.argsort(-lengths, kind="stable")[::-1]:
        left.setdefault(int(lengths[at]), []).append(int(at))
    sizes = sorted(left)
    there = np.zeros(capacity + 1, bool)
    there[sizes] = True
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(size: int) -> int:
        stack = left[size]
        at = stack.pop()
        if not stack:
            del left[size]
            sizes.remove(size)
            there[size] = False
        return at

    def give_back(size: int, at: int) -> None:
        if size not in left:
            insort(sizes, size)
            there[size] = True
        left.setdefault(size, []).append(at)

    number = 0
    while sizes:
        held, room = [], capacity
        while sizes and sizes[0] <= room:
            size = sizes[bisect_right(sizes, room) - 1]
            held.append((size, take(size)))
            room -= size
        smallest = held[-1][0]
        if pair := _two(there, left, smallest, room):
            give_back(*held.pop())
            held += [(size, take(size)) for size in pair]
        offset = 0
        for size, at in held:
            bins[at], offsets[at] = number, offset
            offset += size
        number += 1
    return bins, offsets


def _two(there: np.ndarray, left: dict[int, list[int]], smallest: int, room: int) -> tuple[int, int] | None:
    """The two lengths that best fill the room and the smallest piece's place, if they fill more."""
    if not room or not left:
        return None
    for total in range(smallest + room, smallest, -1):
        low = (total + 1) // 2
        larger = there[low : total + 1] & there[total - low :: -1][: total + 1 - low]
        for size in np.flatnonzero(larger) + low:
            other = total - int(size)
            if other and (other != size or len(left[other]) > 1):
                return int(size), other
    return None


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """The pieces of all rows with their sequence_id and the offset in it."""
    pieces = stored(cut(docs, id_col, text_col, tokenizer), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    block = F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {EQUAL_BLOCK}"))).alias("_block")
    first = F.col("_block") * EQUAL_BLOCK
    number = F.explode(F.sequence(first, F.least("_n", first + EQUAL_BLOCK) - 1)).alias("_number")
    equal = pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("_n"))
    numbered = equal.select("*", block).select(*pieces.columns, number)
    dealt = numbered.withColumn(
        "dealt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_number"), F.lit(groups)).cast("long")
    ).drop("_number")

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        bins, offsets = fill(group["length"].to_numpy())
        return group.assign(sequence_id=bins + group["dealt"] * 2**32, offset=offsets).drop(columns="dealt")

    kind = dict(pieces.dtypes)["doc_id"]
    return dealt.groupBy("dealt").applyInPandas(packed, f"doc_id {kind}, {PIECES}, sequence_id long, offset long")
