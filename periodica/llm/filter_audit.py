"""Audit of how quality filters interact, from one finite-state pass over the bytes of every text.

A *byte transducer* reads UTF-8: one table gives each byte its class (word byte, capital, start of a code point, symbol), a
second one the output of each step between the states "between words" and "inside a word". One pass counts words,
capitals, code points and symbols, and emits the spans of the words. The spans go into a *hash table* by a rolling
hash of their bytes; spans that meet in a slot are compared byte by byte, so that a collision of hashes is never taken
for a repeated word.
Texts longer than ``PIECE_BYTES`` are read piece by piece; the distinct words of such a text are kept from piece to piece.

Five filters read the counts (``FILTERS``); a text fails

* A: under 50 words;
* B: distinct words under 65 % of the words;
* C: capitals A-Z over 5 % of the code points;
* D: any of ``# $ % & * |``;
* E: it is identical to the text of a smaller ``doc_id`` anywhere in the table.

E compares SHA-256 digests. A document is the first of its copies if it has the smallest id of the digest; that is looked up by
(digest, id), so a group of copies that holds a third of all rows is neither gathered nor a hot join key.

What a filter removes depends on the filters before it as a *set*, so the 600 rows of a part (120 orders, 5 steps) follow from the
80 pairs of a filter and a set of others, and those from the counts of each combination of failures (32 at most, by
label). Only these counts are shuffled by part, after a map-side sum; no frame is joined without a key.

Defined results: a null text is empty and has no words (it fails A alone, and E where another empty text has a smaller id); a null
source is the part ''; a document without an id is never smaller than another and fails no E; rows that repeat an id and a
text do not fail E by each other; a label counts if any label row of the id has it; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import cut, per_row

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: Bytes that are read at a time.
PIECE_BYTES = 4 << 20

# Classes of bytes.
SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#$%&*|"
WORD, CAPITAL, START, SYMBOL = 1, 2, 4, 8
CLASS = np.array(
    [
        WORD * (b not in SPACES) | CAPITAL * (65 <= b <= 90) | START * (b & 0xC0 != 0x80) | SYMBOL * (b in SYMBOLS)
        for b in range(256)
    ],
    np.uint8,
)
#: Output of a step: [state before][state after]; the state is 1 inside a word.
OPENS, CLOSES = 1, 2
STEP = np.array([[0, OPENS], [CLOSES, 0]], np.uint8)
#: The rolling hash: multiplier, and its inverse modulo 2^64.
_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, count: int) -> np.ndarray:
    table = np.full(count, base, np.uint64)
    table[:1] = 1
    return np.multiply.accumulate(table)


class WordTable:
    """Spans of words by hash and length, verified byte by byte."""

    def __init__(self, most: int = PIECE_BYTES):
        self.up, self.down = _powers(_RADIX, most + 1), _powers(_INVERSE, most + 1)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span: differences of a running polynomial, moved to the power zero."""
        n = len(data)
        if n + 1 > len(self.up):
            self.up, self.down = _powers(_RADIX, n + 1), _powers(_INVERSE, n + 1)
        running = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=running[1:])
        key = (running[ends] - running[starts]) * self.down[starts]
        key ^= key >> np.uint64(31)
        key *= _MIX
        key ^= key >> np.uint64(29)
        return key

    def first_of_each(self, data: np.ndarray, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the spans that are the first of their word in their document (``owner``)."""
        if not len(starts):
            return np.zeros(0, np.int64)
        size = ends - starts
        key = self.hashes(data, starts, ends) ^ (owner.astype(np.uint64) * np.uint64(_RADIX) + size.astype(np.uint64))
        todo, first = np.arange(len(starts)), []
        while len(todo):
            order = todo[np.argsort(key[todo], kind="stable")]
            slot = key[order]
            head = np.concatenate(([True], slot[1:] != slot[:-1]))
            leader = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
            same = (owner[order] == owner[leader]) & (size[order] == size[leader])
            same[same] = _equal(data, starts[order[same]], starts[leader[same]], size[order[same]])
            first.append(leader[head])
            todo = np.sort(order[~same])  # words that met another word of the same hash: once more among themselves
        return np.concatenate(first)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` equal those from ``b``, for each pair."""
    alike = np.ones(len(a), bool)
    moved = np.flatnonzero(a != b)
    if len(moved):
        a, b, size = a[moved], b[moved], size[moved]
        begins = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(begins, size)
        unequal = data[np.repeat(a, size) + inside] != data[np.repeat(b, size) + inside]
        alike[moved] = np.add.reduceat(unequal, begins) == 0
    return alike


def transduce(data: np.ndarray, bounds: np.ndarray, table: WordTable) -> tuple[np.ndarray, ...]:
    """words, distinct, capitals, code points, symbols of each document, and the first span of each distinct word.

    ``data`` holds the documents one after the other, document ``k`` from ``bounds[k]`` to ``bounds[k + 1]``.
    """
    kind = CLASS[data]
    state = kind & WORD
    before = np.concatenate((np.zeros(1, np.uint8), state[:-1]))
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[heads] = 0  # a document begins between words
    output = STEP[before, state]
    after = np.concatenate((state[1:], np.zeros(1, np.uint8)))
    after[heads[heads > 0] - 1] = 0
    starts = np.flatnonzero(output == OPENS)
    ends = np.flatnonzero(STEP[state, after] == CLOSES) + 1
    owner = np.searchsorted(bounds, starts, side="right") - 1
    first = table.first_of_each(data, owner, starts, ends)
    documents = len(bounds) - 1

    def summed(flag: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind & flag != 0, dtype=np.int64)))
        return total[bounds[1:]] - total[bounds[:-1]]

    words = np.bincount(owner, minlength=documents)
    distinct = np.bincount(owner[first], minlength=documents)
    return words, distinct, summed(CAPITAL), summed(START), summed(SYMBOL), starts[first], ends[first]


def _long_counts(text: bytes, table: WordTable, piece: int) -> list[int]:
    """The counts of one text, read piece by piece; a word that the end of a piece cuts goes on in the next one."""
    known: set[bytes] = set()
    words, kinds, begun = 0, np.zeros(16, np.int64), []

    def close() -> int:
        word = b"".join(begun)
        begun.clear()
        if word:
            known.add(word)
        return int(word != b"")

    for at in range(0, len(text), piece):
        part = text[at : at + piece]
        data = np.frombuffer(part, np.uint8)
        kind = CLASS[data]
        kinds += np.bincount(kind, minlength=16)
        between = np.flatnonzero(kind & WORD == 0)
        begun.append(part if not len(between) else part[: between[0]])
        if len(between):
            words += close()
            low, high = int(between[0]), int(between[-1]) + 1
            inner, *_, starts, ends = transduce(data[low:high], np.array([0, high - low]), table)
            words += int(inner[0])
            known.update(part[low + i : low + j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True))
            begun.append(part[high:])
    words += close()
    return [words, len(known), *(int(kinds[np.arange(16) & flag != 0].sum()) for flag in (CAPITAL, START, SYMBOL))]


def text_counts(texts: list[bytes], table: WordTable, piece: int = PIECE_BYTES) -> list[list[int]]:
    """[words, distinct words, capitals, code points, symbols] of each text."""
    found: list[list[int]] = [[] for _ in texts]
    held, size = [], 0

    def flush() -> None:
        if held:
            bounds = np.cumsum([0, *(len(texts[k]) for k in held)])
            counts = transduce(np.frombuffer(b"".join(texts[k] for k in held), np.uint8), bounds, table)[:5]
            for k, row in zip(held, np.stack(counts, 1).tolist(), strict=True):
                found[k] = row

    for k, text in enumerate(texts):
        if len(text) > piece:
            found[k] = _long_counts(text, table, piece)
            continue
        if size + len(text) > piece:
            flush()
            held, size = [], 0
        held.append(k)
        size += len(text)
    flush()
    return found


def with_counts(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_words``, ``n_distinct``, ``n_capitals``, ``n_codepoints``, ``n_symbols`` and ``digest`` (SHA-256 of the text)."""

    def make():
        table = WordTable()

        def run(texts):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            return [*zip(*text_counts(raw, table), strict=True), [hashlib.sha256(r).digest() for r in raw]]

        return run

    names = ("n_words", "n_distinct", "n_capitals", "n_codepoints", "n_symbols")
    return per_row(docs, ["text"], [*((n, "bigint") for n in names), ("digest", "binary")], make, drop)


def own_failures() -> F.Column:
    """Bits of the filters A to D that a row of ``with_counts`` fails, A the lowest."""
    failed = [
        F.col("n_words") < LEAST_WORDS,
        F.col("n_distinct") * 100 < F.col("n_words") * LEAST_DISTINCT,
        F.col("n_capitals") * 100 > F.col("n_codepoints") * MOST_CAPITALS,
        F.col("n_symbols") > 0,
    ]
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def with_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, failures, good, toxic, n): the failed filters as bits, for ``n`` rows that are alike in all of it and in their text."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    counted = with_counts(docs.select("doc_id", source, F.col("text").cast("string").alias("text")), ("text",))
    rows = counted.groupBy("doc_id", "part", "digest", own_failures().alias("own")).agg(F.count("*").alias("n"))
    rows = cut(rows, "filter-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        *(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))
    )
    late = F.col("first").isNull() & F.col("doc_id").isNotNull()
    joined = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    return joined.select(
        "doc_id",
        "part",
        (F.col("own") + F.when(late, 16).otherwise(0)).alias("failures"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
        "n",
    )


def _placings() -> list[tuple[int, int, list[tuple[str, int]]]]:
    """(filter, set of filters before it as bits, orders in which that is so with the filter's step)."""
    found: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        before = 0
        for step, i in enumerate(order, 1):
            found.setdefault((i, before), []).append((name, step))
            before |= 1 << i
    return [(i, before, places) for (i, before), places in found.items()]


def audit(failures: DataFrame) -> DataFrame:
    """One row for each part, ``filter_order`` and ``step``, from the rows of ``with_failures``."""
    cells = failures.groupBy("part", "failures").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )
    placings = _placings()
    pairs = F.array(*(F.struct(F.lit(1 << i).alias("own"), F.lit(b).alias("before")) for i, b, _ in placings))
    spread = cells.select("*", F.inline(pairs))
    own = F.col("own")
    fails = F.col("failures").bitwiseAND(own) != 0
    gone = F.col("failures").bitwiseAND(F.col("before")) != 0

    def count(condition: F.Column, value: str = "n") -> F.Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    summed = spread.groupBy("part", "own", "before").agg(
        count(~fails & ~gone).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(F.col("failures") == own).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"),
        count(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    # An order and step for each placing; a set of k others comes first in k! (4 - k)! orders, all of which are listed.
    listed = {(1 << i, b): F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step")) for o, s in places)) for i, b, places in placings}
    places = F.coalesce(*(F.when((own == i) & (F.col("before") == b), v) for (i, b), v in listed.items()))
    others = len(FILTERS) - 1
    times = F.get(F.array(*(F.lit(factorial(k) * factorial(others - k)) for k in range(others + 1))), F.bit_count("before"))
    shapley = summed.groupBy("part", "own").agg(F.sum(F.col("removed") * times).alias("shapley"))
    rows = summed.join(shapley, ["part", "own"]).select("*", F.explode(places).alias("place"))
    measures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return rows.select("part", "place.filter_order", "place.step", *(F.col(m).cast("bigint").alias(m) for m in measures))


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs``: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for each part, order and step."""
    return audit(with_failures(docs, labels))
