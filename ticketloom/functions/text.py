"""Text normalisation, cleaning rules and text assembly."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom import names
from ticketloom.functions import wordlists

# Letters and signs whose plain form is longer than one character (fixed values).
_EXPANSIONS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "€": "EUR", "°": "deg", "©": "(c)", "®": "(r)", "§": "SS", "«": "<<",
    "»": ">>", "…": "...",
}
# Letters without a Unicode decomposition, and typographic punctuation.
_SINGLES = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L",
    "ħ": "h", "Ħ": "H", "ı": "i", "ŋ": "n", "Ŋ": "N", "ª": "a", "º": "o",
    "¹": "1", "²": "2", "³": "3", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"',
    "„": '"', "–": "-", "—": "-", "•": "*", "·": "*", "×": "x", "÷": "/",
    "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}


def _accent_map() -> dict[str, str]:
    """Every Latin letter whose decomposition starts with one ASCII letter."""
    table = dict(_SINGLES)
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(plain) == 1 and plain.isalpha():
            table[chr(point)] = plain
    return table


# Cyrillic and Greek by letter, in the manner of the reference's unidecode (fixed values).
_SCRIPTS = dict(zip("абвгдезиклмнопрстуфыэіјѕґ", "abvgdeziklmnoprstufyeijzg"))
_SCRIPTS |= {
    "ж": "zh", "й": "i", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "'", "ь": "'",
    "ю": "iu", "я": "ia", "ё": "io", "ђ": "dj", "ѓ": "gj", "є": "ie", "ї": "yi", "љ": "lj", "њ": "nj",
    "ћ": "tsh", "ќ": "kj", "ў": "u", "џ": "dzh", "ѕ": "dz",
}
_SCRIPTS |= dict(zip("αβγδεζηικλμνξοπρσςτυω", "abgdezeiklmnxoprsstuo"))
_SCRIPTS |= {"θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps"}


def _script_map() -> dict[str, str]:
    """The letters of _SCRIPTS in both cases, and those that are one of them with marks."""
    table = {}
    for point in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        sign = chr(point)
        low = sign.lower()
        plain = _SCRIPTS.get(low) or _SCRIPTS.get(unicodedata.normalize("NFKD", low)[0])
        if plain and unicodedata.category(sign)[0] == "L":
            table[sign] = plain if sign == low else plain.capitalize()
    return table


_LATIN = _accent_map()
_OTHER_SCRIPTS = {sign: plain for sign, plain in _script_map().items() if len(plain) > 1}
_ACCENTS = _LATIN | {sign: plain for sign, plain in _script_map().items() if len(plain) == 1}
# What no text in Latin letters and common signs holds; all that needs more than the Latin map is in here.
_BEYOND_LATIN = r"[\x{370}-\x{1DFF}\x{1F00}-\x{1FFF}\x{2C00}-\x{10FFFF}]"
# Letters of scripts without a map stay as they are; other signs outside ASCII go.
_UNMAPPED = r"[\p{L}\p{M}&&[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]]|\x{30FC}"
ACCENTED = "".join(_ACCENTS)
PLAIN = "".join(_ACCENTS.values())

# Python counts the four ASCII separators as white space; Java's \s does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
WHITESPACE = r"[\s\x1c-\x1f]"
_WORD_RUN = r"[\p{L}\p{N}_]{2,}"

# An address is a run of non-blanks with an @ that is neither first nor last in it. The
# pattern enters a run only at its start and reads it once, so long runs stay linear.
EMAIL = r"(?:^|\s)\S[^\s@]*+@\S+"
URL = r"http\S+|www\S+"
FIRST_URL = r'https?://[^\s<>"]+|www\.[^\s<>"]+'


def _only_if(text: Column, present: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """Apply a costly step only to texts that can be changed by it.

    The text is bound once, as the element of a one-element array: naming it in the
    test and in both branches would compute all steps before it three times.
    """
    changed = F.transform(F.array(text), lambda t: F.when(present(t), step(t)).otherwise(t))
    return changed[0]


def _expand(text: Column, signs: dict[str, str]) -> Column:
    for sign, plain in signs.items():
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


def _spelled_out(text: Column) -> Column:
    """Letters of other scripts that become several, in one pass whatever their number.

    The text is cut at these letters, and each is looked up by its place in the code table. Java
    tries the members of a class in turn: both classes begin with the test that parts most texts.
    """
    points = sorted(map(ord, _OTHER_SCRIPTS))
    first, last = points[0], points[-1]
    between = [(p + 1, q - 1) for p, q in zip(points, points[1:]) if q - p > 1]
    span = lambda a, b: rf"\x{{{a:x}}}-\x{{{b:x}}}"
    letter = f"[{span(first, last)}&&[{''.join(span(p, p) for p in points)}]]"
    rest = f"[{span(0, first - 1)}[{span(last + 1, 0x10FFFF)}{''.join(span(*gap) for gap in between)}]]+"
    spelling = F.array(*[F.lit(_OTHER_SCRIPTS.get(chr(point))) for point in range(first, last + 1)])
    pieces = F.regexp_extract_all(text, F.lit(f"{rest}|{letter}"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.get(spelling, F.ascii(p) - first), p)), "")


def _swapped(text: Column, signs: dict[str, str]) -> Column:
    """Rare signs that need more than one letter: texts without any skip the step."""
    present = "[" + "".join(signs) + "]"
    return _only_if(text, lambda t: t.rlike(present), lambda t: _expand(t, signs))


def to_ascii(text: Column, *, blanks: str = "") -> Column:
    """Transliterate to ASCII. Letters of scripts without a map stay, ``blanks`` become ' '.

    One test parts the texts: those in Latin letters only never meet the steps for other scripts.
    """
    spaces = " " * len(blanks)

    def latin(t: Column) -> Column:
        t = F.translate(t, "".join(_LATIN) + blanks, "".join(_LATIN.values()) + spaces)
        return F.regexp_replace(t, r"[^\x00-\x7F]+", "")

    def mixed(t: Column) -> Column:
        t = F.translate(_spelled_out(t), ACCENTED + blanks, PLAIN + spaces)
        return F.regexp_replace(t, rf"(?=[^\x00-\x7F])(?:(?!{_UNMAPPED})[^\x00-\x7F])+", "")

    plain = _swapped(text, _EXPANSIONS)
    return F.transform(F.array(plain), lambda t: F.when(t.rlike(_BEYOND_LATIN), mixed(t)).otherwise(latin(t)))[0]


def normalize(text: Column) -> Column:
    """Lower case first, then ASCII: the order the cleaner uses."""
    return to_ascii(F.lower(text))


def normalize_name(text: Column) -> Column:
    """ASCII first, then lower case, then trimmed: the order the name list uses."""
    return strip(F.lower(to_ascii(text)))


def normalize_label(label: str) -> str:
    """Driver-side twin of :func:`normalize` for column headers."""
    label = label.lower()
    for sign, plain in (_EXPANSIONS | _OTHER_SCRIPTS).items():
        label = label.replace(sign, plain)
    label = label.translate(str.maketrans(_ACCENTS))
    return "".join(c for c in label if c.isascii() or _is_unmapped(c))


def _is_unmapped(sign: str) -> bool:
    """Driver-side twin of ``_UNMAPPED``, by the script that begins the letter's name."""
    common = ("LATIN", "MODIFIER", "COMBINING", "FEMININE", "MASCULINE", "MICRO", "MATHEMATICAL", "FULLWIDTH LATIN")
    return sign == "\u30fc" or (unicodedata.category(sign)[0] in "LM" and not unicodedata.name(sign, "LATIN").startswith(common))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{WHITESPACE}+", " "))


def raw_tokens(text: Column) -> Column:
    """Greetings, addresses and links out; the rest cut at every non-word sign.

    Cutting at non-word signs is the same as blanking punctuation and splitting at
    white space: the underscore stays inside tokens, and all that is not ASCII here is a letter.
    The result may hold '' at either end; the length rule removes it.
    """
    text = to_ascii(F.lower(F.coalesce(text, F.lit(""))), blanks=SEPARATORS)
    for greeting in wordlists.GREETINGS:
        text = F.replace(text, F.lit(greeting), F.lit(" "))
    text = _only_if(text, lambda t: t.contains("@"), lambda t: F.regexp_replace(t, EMAIL, " "))
    text = _only_if(
        text,
        lambda t: t.contains("http") | t.contains("www"),
        lambda t: F.regexp_replace(t, URL, " "),
    )
    return F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+")


def is_content_token(token: Column) -> Column:
    """Token rules that need no word list."""
    keep = F.length(token) > 2
    keep &= F.replace(token, F.lit("x"), F.lit("")) != ""
    keep &= ~token.rlike("[0-9]")
    for prefix in wordlists.SALUTATION_PREFIXES:
        keep &= ~token.startswith(prefix)
    return keep


def drop_listed(tokens: Column, words: Iterable[str]) -> Column:
    """Tokens that are in none of the lists; one hash-set probe per token.

    The set is handed over as one SQL text: building tens of thousands of literal
    columns one by one takes seconds. Only words made of word signs can be equal
    to a token, so nothing in the text needs escaping.
    """
    listed = sorted(w for w in set(words) if all(c == "_" or (c.isalnum() if c.isascii() else _is_unmapped(c)) for c in w) and w)
    if not listed:
        return tokens
    members = F.expr("token -> token NOT IN (" + ",".join(f"'{w}'" for w in listed) + ")")
    return F.call_function("filter", tokens, members)


def stopwords() -> frozenset[str]:
    """Portuguese and domain stop words, normalised."""
    return frozenset(
        normalize_label(w)
        for w in (*wordlists.PORTUGUESE_STOPWORDS, *wordlists.DOMAIN_STOPWORDS)
    )


def content_tokens(text: Column, dropped: Iterable[str]) -> Column:
    """Token array of a text after every rule and the given word lists."""
    return drop_listed(F.filter(raw_tokens(text), is_content_token), dropped)


def words(text: Column) -> Column:
    """Lower-case word runs of two or more signs, as the term tables count them."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD_RUN), F.lit(0))


def first_url(text: Column) -> Column:
    """First link in a text, NULL if there is none."""
    return F.regexp_substr(text, F.lit(FIRST_URL))


def full_text(title: Column, description: Column) -> Column:
    """Title and description in one line; an empty part leaves no trace."""
    empty = F.lit("")
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Título: "), F.nullif(collapse(title), empty)),
        F.concat(F.lit("Descrição: "), F.nullif(collapse(description), empty)),
    )


def topic_text(
    title: Column, pattern: Column, impact: Column, keywords: Column | None = None
) -> Column:
    """Text of a topic to be embedded, with or without its keywords."""
    empty = F.lit("")
    parts = [
        F.coalesce(title, empty), F.lit(". "), F.coalesce(pattern, empty), F.lit(" "),
        F.coalesce(impact, empty),
    ]
    if keywords is not None:
        parts += [F.lit(" "), F.coalesce(keywords, empty)]
    return collapse(F.concat(*parts))


def condensed_summary(pattern: Column, impact: Column) -> Column:
    """Pattern and impact in one line."""
    empty = F.lit("")
    return collapse(
        F.concat(
            F.lit("Padrão Dominante: "), F.coalesce(pattern, empty),
            F.lit(" Impacto Operacional: "), F.coalesce(impact, empty),
        )
    )


def keyword_string(terms: Column) -> Column:
    """Terms joined by comma; no terms give ''."""
    return F.coalesce(F.array_join(terms, ", "), F.lit(""))


def quoted_keyword_string(terms: Column) -> Column:
    """Quoted terms joined by comma, or the placeholder."""
    quoted = F.array_join(
        F.transform(terms, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", "
    )
    return F.when(F.size(terms) > 0, quoted).otherwise(F.lit(names.NO_KEYWORDS))


def preview(text: Column, longest: int = 180, kept: int = 177) -> Column:
    """One-line preview: longer texts are cut and end in dots."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(
        F.length(line) > longest, F.concat(F.substring(line, 1, kept), F.lit("..."))
    ).otherwise(line)


def action_preview(action: Column) -> Column:
    """Short preview of the last action; a missing one gets the standard sentence."""
    shown = F.coalesce(action, F.lit(names.NO_ACTION))
    return F.when(
        F.length(shown) > 100, F.concat(F.substring(shown, 1, 100), F.lit("..."))
    ).otherwise(shown)
