"""Text, unit, region and number cleaning as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped by normalize_text.
STOP_WORDS = ["complete", "including", "with", "and", "of", "the", "type"]

# Unit synonyms, keyed by the normalized unit without spaces.
UNIT_SYNONYMS = {
    "m3": "m3",
    "m^3": "m3",
    "m2": "m2",
    "sqm": "m2",
    "sqm.": "m2",
    "sq.m": "m2",
    "sqmeter": "m2",
    "sqmtr": "m2",
    "kw": "kw",
    "kilowatt": "kw",
    "cfm": "cfm",
    "nr": "nr",
    "no": "nr",
    "nos": "nr",
    "pcs": "nr",
    "item": "item",
    "sum": "sum",
    "ls": "sum",
    "tonne": "ton",
    "tonnes": "ton",
    "ton": "ton",
}

# Region names by normalized label.
REGION_ALIASES = {
    "nrb": "Nairobi",
    "nai": "Nairobi",
    "nairobi county": "Nairobi",
    "nyanza region": "Nyanza",
    "kisumu": "Nyanza",
    "western kenya": "Western",
}

# Sections by a hint in the sheet's name, the first hint that occurs.
SHEET_HINTS = {
    "preliminaries": "Preliminaries",
    "dayworks": "Dayworks",
    "contractor equipment": "Dayworks",
    "contractor s equipment": "Dayworks",
    "contractors equipment": "Dayworks",
    "plant": "Dayworks",
    "plant hire": "Dayworks",
    "earthworks": "Earthworks",
    "concrete": "Concrete",
    "general items": "Preliminaries",
    "finishes": "Finishes",
}

TRUE_WORDS = ["1", "true", "yes", "y", "active"]


def _folds() -> tuple[str, str]:
    """Letters and digits whose compatibility decomposition leaves one ASCII character, and that character."""
    pairs = []
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def text(x: Column | str) -> Column:
    """A null is an empty text."""
    return F.coalesce(column(x).cast("string"), F.lit(""))


#: ASCII characters, lower-cased, that are no part of a word.
BETWEEN = "".join(c for c in map(chr, range(128)) if not re.fullmatch(r"[a-z0-9./ ]", c))
#: Words that are written as one: what a text must contain, the pattern, the word.
UNIFIED = [(("cfm", "c.fm", "cf.m", "c.f.m"), r"\bc\.?f\.?m\b", "cfm"), (("tonne",), r"\btonnes?\b", "ton"), (("litre",), r"\blitres?\b", "litre"), (("hr",), r"\bhrs?\b", "hr")]


def _unified(words: tuple[str, ...], pattern: str, new: str) -> Callable[[Column], Column]:
    """The pattern is looked for only where one of the words is: most texts hold none, and finding that out costs less."""
    return lambda v: F.when(reduce(or_, (F.contains(v, F.lit(w)) for w in words)), F.regexp_replace(v, pattern, new)).otherwise(v)


def normalize_text(x: Column | str) -> Column:
    """Fold accents, lower-case, unify a few unit words, keep [a-z0-9./ ], drop stop words, single spaces."""
    ascii_only = lambda v: F.when(F.octet_length(v) == F.char_length(v), v).otherwise(F.regexp_replace(F.translate(v, FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]", ""))
    v = F.lower(let(text(x), ascii_only))
    for old, new in (("m^3", "m3"), ("m^2", "m2")):
        v = F.replace(v, F.lit(old), F.lit(new))
    v = F.regexp_replace(v, r"(\d)\s*[^a-z0-9./ ]+\s*(\d)", "$1 $2")
    for one in UNIFIED:
        v = let(v, _unified(*one))
    words = F.split(F.translate(v, BETWEEN, " " * len(BETWEEN)), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS)), " ")


def plain_normalized(x: str) -> str:
    """normalize_text of one word on the driver, for headers."""
    v = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()
    return " ".join(w for w in re.sub(r"[^a-z0-9./ ]+", " ", v).split() if w not in STOP_WORDS)


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, key), default)


def normalize_unit(x: Column | str) -> Column:
    """Normalized text without spaces, by the synonyms; an unknown unit passes."""
    return let(F.replace(normalize_text(x), F.lit(" "), F.lit("")), lambda key: _lookup(UNIT_SYNONYMS, key, key))


def title_case(x: Column | str) -> Column:
    """Upper-case after every character that is no letter, else lower-case."""
    pieces = F.regexp_extract_all(F.lower(column(x)), F.lit(r"([a-z]+|[^a-z]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, F.initcap), "")


def normalize_region(x: Column | str) -> Column:
    """By the aliases, else the normalized text in title case; blank stays blank."""
    return let(normalize_text(x), lambda key: _lookup(REGION_ALIASES, key, title_case(key)))


def safe_number(x: Column | str, kind: str = "double") -> Column:
    """A number after trimming and dropping commas; otherwise null."""
    v = F.replace(F.trim(text(x)), F.lit(","), F.lit(""))
    return F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v).try_cast(kind)


def plain_number(x: Column | str, default: float = 0.0) -> Column:
    """A number without commas, else the default."""
    v = F.trim(text(x))
    return F.coalesce(F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v).try_cast("double"), F.lit(default))


def truthy(x: Column | str) -> Column:
    """C06 for a value."""
    return F.lower(F.trim(text(x))).isin(TRUE_WORDS)


def active(x: Column | str) -> Column:
    """Blank counts as active."""
    return F.when(text(x) == "", F.lit(True)).otherwise(truthy(x))


def slugify(x: Column | str) -> Column:
    """Runs of other characters become _, none at the ends; nothing left: output."""
    v = F.regexp_replace(F.regexp_replace(text(x), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(v == "", F.lit("output")).otherwise(v)


def clean_text(x: Column | str) -> Column:
    """White space collapsed."""
    return F.trim(F.regexp_replace(text(x), r"(?U)\s+", " "))


def lowered(x: Column | str) -> Column:
    """Lower case, white space collapsed, punctuation kept."""
    return F.lower(clean_text(x))


def titleize(x: Column | str) -> Column:
    """A key as a title."""
    return F.initcap(F.replace(column(x), F.lit("_"), F.lit(" ")))


def heading_like(x: Column | str) -> Column:
    """C11: all upper case, or ends with a colon, or at most six words."""
    return let(clean_text(x), lambda v: (v != "") & (((F.upper(v) == v) & (F.lower(v) != v)) | v.endswith(":") | (F.size(F.split(v, " ")) <= 6)))


def bullet_text(x: Column | str) -> Column:
    """Without leading dashes and trailing colons."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(column(x)), r"^-+", "")), r":+$", ""))


def sheet_section(x: Column | str) -> Column:
    """The section that a sheet's name hints at, else blank."""

    def first(v: Column) -> Column:
        out = F.lit("")
        for hint, section in reversed(SHEET_HINTS.items()):
            out = F.when(F.contains(v, F.lit(hint)), F.lit(section)).otherwise(out)
        return out

    return let(F.regexp_replace(normalize_text(x), r"\bbill no\b", "bill"), first)


def subtotal_flag(row_text: Column) -> Column:
    """C16, first part."""
    return row_text.rlike("subtotal|sub total|carried forward|brought forward")


def total_flag(row_text: Column) -> Column:
    """C16, second part: the word total anywhere, or contract sum."""
    return row_text.rlike("total|contract sum")


def clamp(x: Column, low: float, high: float) -> Column:
    """C25."""
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def yes_no(x: Column, upper: bool = False) -> Column:
    """C29."""
    return F.when(x, F.lit("YES" if upper else "Yes")).otherwise(F.lit("NO" if upper else "No"))
