"""Text normalisation and matching as column expressions (no UDFs)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by a Unicode-aware strip, as opposed to SQL trim (spaces only).
_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
_COMBINING_MARKS = "".join(chr(i) for i in range(0x300, 0x370) if unicodedata.combining(chr(i)))
# Blocks covered by the accent table: Latin-1 Supplement, Latin Extended-A/B, Latin Extended Additional.
_ACCENT_BLOCKS = (range(0xA0, 0x250), range(0x1E00, 0x1F00))


def plain_text(value: str) -> str:
    """Decompose and drop combining marks; used on header names and to derive the table below."""
    decomposed = unicodedata.normalize("NFKD", value)
    return "".join(ch for ch in decomposed if unicodedata.combining(ch) == 0)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, dict[str, str]]:
    """(accented, plain, expansions): one-to-one letters, and characters that become several."""
    source, target, expansions = [], [], {}
    for block in _ACCENT_BLOCKS:
        for ch in map(chr, block):
            plain = plain_text(ch)
            if plain == ch:
                continue
            if len(plain) == 1:
                source.append(ch)
                target.append(plain)
            else:
                expansions[ch] = plain
    # translate() deletes characters that have no counterpart: put the bare marks last.
    return "".join(source) + _COMBINING_MARKS, "".join(target), expansions


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def strip_accents(c: Column) -> Column:
    """Accent-free text. ASCII values, the bulk of a registry, skip the table."""
    source, target, expansions = _accent_table()
    out = F.translate(c, source, target)
    out = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), expansions.items(), out)
    return F.when(_is_ascii(c), c).otherwise(out)


def strip(c: Column) -> Column:
    """Remove every kind of surrounding white space."""
    return F.btrim(c, F.lit(_WHITESPACE))


def normalize_text(c: Column) -> Column:
    """Accent-free, upper-case, inner white space collapsed, NULL as the empty string."""
    upper = F.upper(strip_accents(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(upper, r"(?U)[\s\x1c-\x1f]+", " "))


# The letters a label is stripped of, and their replacements.
LABEL_ACCENTS = "ÁÀÃÂÉÊÍÓÔÕÚÇ"
LABEL_PLAIN = "AAAAEEIOOOUC"


def normalize_label(c: Column) -> Column:
    """Stripped upper-case label without the twelve accented letters above."""
    return F.translate(F.upper(strip(c)), LABEL_ACCENTS, LABEL_PLAIN)


# Fixed value: the city text that marks stock without a known place.
NO_INFORMATION = "SEM INFORMAÇÃO"


def is_no_information(c: Column, accent_sensitive: bool = True) -> Column:
    """The "no information" city bucket.

    The strict form compares the trimmed upper-case text with the accented literal; the
    lenient form ignores accents and inner white space on both sides.
    """
    if accent_sensitive:
        return F.upper(F.trim(c)) == F.lit(NO_INFORMATION)
    return normalize_text(c) == F.lit(plain_text(NO_INFORMATION))


def contains_any(c: Column, tokens: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in tokens], F.lit(False))


def like_ignore_case(c: Column, pattern: str) -> Column:
    """Case-insensitive LIKE in which a backslash is an ordinary character."""
    # Both sides are upper-cased by Spark, whose Unicode tables may be newer than Python's.
    return F.like(F.upper(c), F.upper(F.lit(pattern.replace("\\", "\\\\"))))


def title_case(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest."""
    pieces = F.split(F.lower(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(pieces, F.initcap), "")
