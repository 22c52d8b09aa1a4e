"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate what stands around them.

An *anchor* is a short string without which a kind of personal data cannot occur: the at-sign of an email address, two
numbers at a dot, two digits of a number, a plus before a digit, the ``://`` of a scheme, the name of an identifier. One Aho-Corasick
automaton reports all anchors of a text from left to right. At each, the parser of its kind finds the left and right
boundary and validates what lies between; text without an anchor is never looked at again.

| kind | anchor | boundaries and validation |
|---|---|---|
| email | ``@`` | local characters to the left, a host of two labels or more to the right |
| ip | digit, dot, digit | chains of numbers, four at a time, each at most 255 |
| card | two digits, a space or hyphen between them at most | the whole chain; 12 to 19 digits that pass the Luhn sum |
| phone | ``+`` and a digit | digits, spaces, dots, hyphens and brackets up to the last digit; 9 to 15 digits |
| address | ``://`` | scheme to the left, user information, host and port to the right; without a user it is no one's |
| account | names of identifiers (``CUES``) | the identifier behind the name: an IBAN whose checksum is right, or 6 to 18 digits behind up to three letters |

Each parser moves to the right only and never reads a character twice for the same kind (but for the digits before a dot), so a text costs
time in proportion to its length, whatever it holds. The first four kinds are the *base*: their spans are the
leftmost non-overlapping matches of ``BASE``, less those that fail validation. Kinds may overlap one another.

Offsets are code points, ends exclusive. Defined results: a null or empty text holds nothing; repeated rows are searched each; an
empty table gives no rows; other columns pass through, and one called like an output, in any case, is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import LOWER, per_row

# What the base spans are matches of.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Names of identifiers.
CUES = (
    "iban",
    "account",
    "acct",
    "ssn",
    "passport",
    "konto",
    "compte",
    "cuenta",
)
KINDS = (*BASE, "address", "account")
ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*(:[0-9]+)?"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
ACCOUNT = (
    rf"\b(?i:{'|'.join(CUES)})(?i: ?(?:number|no|nr|id)\b\.?)?[ \t]?[:#=]?[ \t]?"
    rf"({IBAN}|[A-Za-z]{{0,3}}[0-9](?:[ -]?[0-9]){{5,17}})\b"
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(BASE["card"])
_PHONE = re.compile(BASE["phone"])
_ADDRESS = re.compile(ADDRESS)
_ACCOUNT = re.compile(ACCOUNT, re.ASCII)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,}")
_NO_DIGIT = re.compile(r"[^0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Spans = list[tuple[int, int]]


def passes_luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[d] for d in values[1::2])) % 10 == 0


def passes_iban(text: str) -> bool:
    """Whether the letters and digits of ``text`` leave 1 modulo 97, country and check digits moved to the end."""
    bare = text.replace(" ", "")
    return bool(_IBAN.fullmatch(bare)) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


# A parser gets the text, the anchor's place and the place its kind has read up to; it adds spans and returns how far it has read.


def _email(text: str, anchor: int, read: int, spans: Spans) -> int:
    first = anchor
    while first > read and text[first - 1] in _LOCAL:
        first -= 1
    host = _HOST.match(text, anchor + 1) if first < anchor else None
    if not host:
        return read
    spans.append((first, host.end()))
    return host.end()


def _ip(text: str, anchor: int, read: int, spans: Spans) -> int:
    first = anchor
    while first > read and text[first - 1] in "0123456789":
        first -= 1
    chain = _DOTTED.match(text, first)
    numbers = [m.span() for m in _NUMBER.finditer(text, first, chain.end())]
    for at in range(0, len(numbers) - 3, 4):
        four = numbers[at : at + 4]
        if all(len(n) <= 3 and int(n or "0") <= 255 for n in (text[a:b].lstrip("0") for a, b in four)):
            spans.append((four[0][0], four[3][1]))
    return chain.end()


def _card(text: str, anchor: int, read: int, spans: Spans) -> int:
    chain = _CARD.match(text, anchor)
    digits = _NO_DIGIT.sub("", chain.group())
    if 12 <= len(digits) <= 19 and passes_luhn(digits):
        spans.append(chain.span())
    return chain.end()


def _phone(text: str, anchor: int, read: int, spans: Spans) -> int:
    number = _PHONE.match(text, anchor)
    if not number:
        return read
    if 9 <= len(_NO_DIGIT.sub("", number.group())) <= 15:
        spans.append(number.span())
    return number.end()


def _address(text: str, anchor: int, read: int, spans: Spans) -> int:
    first = at = anchor
    while at > read and text[at - 1] in _SCHEME:
        at -= 1
        if text[at] not in "0123456789+.-":
            first = at
    found = _ADDRESS.match(text, first) if first < anchor else None
    if not found:
        return read
    spans.append(found.span())
    return found.end()


def _account(text: str, anchor: int, read: int, spans: Spans) -> int:
    found = _ACCOUNT.match(text, anchor)
    if not found:
        return read
    first, end = found.span(1)
    if _IBAN.match(found.group(1).replace(" ", "")):
        # Groups behind the number may be words in capitals: the longest run of groups with a right checksum counts.
        groups = found.group(1).split(" ")
        runs = (" ".join(groups[:k]) for k in range(len(groups), 0, -1))
        end = next((first + len(run) for run in runs if passes_iban(run)), first)
    if end > first:
        spans.append((first, end))
    return found.end()


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "address": _address, "account": _account}


def anchors() -> dict[str, list[str]]:
    """For each kind, the strings that find it, in small letters."""
    digits = "0123456789"
    return {
        "email": ["@"],
        "ip": [f"{a}.{b}" for a in digits for b in digits],
        "card": [a + between + b for a in digits for between in ("", " ", "-") for b in digits],
        "phone": ["+" + a for a in digits],
        "address": ["://"],
        "account": list(CUES),
    }


def finder() -> Callable[[str | None], list[tuple[int, int, int]]]:
    """A function from a text to its spans: (start, number of the kind, end), in that order."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for number, (kind, strings) in enumerate(anchors().items()):
        for string in strings:
            automaton.add_word(string, (number, len(string) - 1))
    automaton.make_automaton()
    parsers = [_PARSERS[kind] for kind in KINDS]

    def find(text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        read = [0] * len(KINDS)
        spans: list[Spans] = [[] for _ in KINDS]
        small = text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
        for last, (kind, before) in automaton.iter(small):
            anchor = last - before
            if anchor >= read[kind]:
                read[kind] = parsers[kind](text, anchor, read[kind], spans[kind])
        return sorted((a, kind, b) for kind, found in enumerate(spans) for a, b in found)

    return find


def with_personal_data(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``personal``: the spans found, ordered by start, then kind as listed in ``KINDS``."""

    def make():
        find = finder()

        def run(texts):
            return ([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t)] for t in texts],)

        return run

    return per_row(docs, ["text"], [("personal", "array<struct<kind:string,start:bigint,end:bigint>>")], make, drop)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by its kind in angle brackets; spans that overlap become one, of the first's kind."""
    at = docs.columns.index("text")

    def make():
        find = finder()

        def clean(text):
            parts, reach = [], 0
            for a, kind, b in find(text):
                if a >= reach:
                    parts += [text[reach:a], f"<{KINDS[kind]}>"]
                reach = max(reach, b)
            return "".join(parts) + text[reach:] if parts else text

        return lambda texts: ([clean(t) for t in texts],)

    names = [f"_{i}" for i in range(len(docs.columns))]
    cleaned = per_row(docs.toDF(*("text" if i == at else n for i, n in enumerate(names))), ["text"], [("text", "string")], make)
    return cleaned.select(*("text" if i == at else n for i, n in enumerate(names))).toDF(*docs.columns)


def count_kinds(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, and all spans as ``kind:start:end``, of rows of ``with_personal_data``."""

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds: str) -> F.Column:
        return F.filter("personal", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(joined(of(*BASE)).cast("binary"), 256).alias("base_sha256"), joined(F.col("personal")).alias("spans")
    )
