"""Words of letters and digits, in Python over UTF-8 bytes and in Spark over strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every byte of a character beyond ASCII is above 0x7F, so bytes part as characters do.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case."""
    return _WORD.findall((text or b"").lower())


def places(text: bytes) -> list[tuple[int, int]]:
    """Where in the bytes each of those words stands."""
    return [m.span() for m in _WORD.finditer(text.lower())]


def words_of(text: Column) -> Column:
    """The same as a column expression; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(_PATTERN), F.lit(0))
