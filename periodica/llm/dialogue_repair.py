"""Repair of conversations as lightest derivations, found by Knuth's agenda.

The rows of a conversation, ordered by turn, are edited until their roles read ``(s?(ua)+)?``: an optional system row, then
user and assistant in turn. Keep costs 0, Rerole 3, Delete 4, Insert 3 (a row without text); rows at fault as blank or duplicate have to be
deleted, and a truncated row that stays costs 3 more.

An *item* ``(i, q)`` says that the rows from ``i`` on can be repaired when the grammar is in state ``q``. Deductions are
weighted hyperedges: ``(i + 1, q')`` gives ``(i, q)`` by keeping, reroling or deleting row ``i``, and ``(i, q')`` gives ``(i, q)`` by an
insertion. The weight of an item is (cost, audit), the audit being the initials of its edits. Different edits of one item begin with different
letters and each letter leads to one state, so the order of two audits of an item shows in the first letter, and an item
keeps only that letter and its antecedent. The agenda pops items by cost, then rows covered, then audit: every deduction
raises one of the first two and leaves the order of its antecedents as it is (the functions are superior and monotone), so
what is popped is final, and the search ends with the goal item ``(0, start)``.

Conversations of any length: rows are ordered over all tasks by (conversation, turn), not gathered by conversation, and
only marks of a byte or so travel to this first pass. A task repairs the conversations that lie whole in its range; of one that
the range's ends may cut, or that is longer than ``STRETCH_ROWS``, it derives for every state before and every state after the
lightest items of each stretch. Stretches are joined by the two-antecedent deduction ``(p, stretch, q) + (q, rest) -> (p, both)`` in a second
pass, ordered by conversation, which reads the chosen letters together with the rows, one after the other, and never holds
the texts of a conversation. The digest of a repaired conversation is one chain of SHA-256 over its text by definition; that chain is the
only work that a single long conversation does in one task. Rows that repeat turn, role and text are counted before they are shuffled.

Defined results: rows are ordered by turn (null first), then role, then SHA-256 of ``role:text``; a null role or text is one space; a role fits by its
first character, an empty one nowhere; a conversation without an id is one conversation; a blank row's text is not carried; a conversation of which no row is left is empty; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of the grammar (start, after s, after u, after a), costs, white space and ends of sentences.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Where a reroled or inserted row leads: to the user, or to the assistant after a user.
TURNED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\v\f\r"
CLOSING = (".", "!", "?")
#: Marks of a row: "-" has to be deleted; a role's initial, "x" for others, in capitals if the row is truncated.
INITIALS = "sua"
#: Conversations of one pattern are derived once; longer ones seldom repeat.
CACHED_ROWS = 64
#: Rows of a stretch: what a task holds at a time, however long a conversation is.
STRETCH_ROWS = 5000

Items = dict[tuple[int, int], tuple[int, str, int]]


def derive(marks: str, ends: tuple[int, ...], goal: int | None = START, insert_last: bool = True) -> Items:
    """The lightest items, as (cost, first letter, state after it), from the axioms (all rows, q) for q in ``ends``.

    Without a ``goal`` state all items are derived. ``insert_last`` allows insertions behind the last row.
    """
    final: Items = {}
    rows = len(marks)
    agenda = [(0, 0, "", q, q) for q in ends]
    while agenda:
        cost, covered, letter, q, after = heapq.heappop(agenda)
        i = rows - covered
        if (i, q) in final:
            continue
        final[i, q] = cost, letter, after
        if i == 0 and q == goal:
            break
        if i < rows or insert_last:
            for p in range(4):
                if TURNED[p] == q:
                    heapq.heappush(agenda, (cost + INSERT, covered, "I", p, q))
        if not i:
            continue
        mark = marks[i - 1]
        heapq.heappush(agenda, (cost + DELETE, covered + 1, "D", q, q))
        if mark == "-":
            continue
        stays = cost + (TRUNCATED if mark.isupper() else 0)
        for p in range(4):
            if MOVES[p].get(mark.lower()) == q:
                heapq.heappush(agenda, (stays, covered + 1, "K", p, q))
            if TURNED[p] == q:
                heapq.heappush(agenda, (stays + REROLE, covered + 1, "R", p, q))
    return final


def read_audit(items: Items, state: int, rows: int) -> tuple[str, int]:
    """The letters of the item (0, ``state``), and the state in which it ends."""
    letters, i = [], 0
    while True:
        _, letter, after = items[i, state]
        if not letter:
            return "".join(letters), state
        letters.append(letter)
        i += letter != "I"
        state = after


def _repair(marks: str) -> tuple[int, str]:
    items = derive(marks, (START, ASSISTANT))
    return items[0, START][0], read_audit(items, START, len(marks))[0]


_repair_short = lru_cache(1 << 16)(_repair)


def repair_marks(marks: str) -> tuple[int, str]:
    """Cost and audit of the lightest repair of a whole conversation."""
    return _repair_short(marks) if len(marks) <= CACHED_ROWS else _repair(marks)


def stretch_weights(marks: str) -> list[tuple[int, str] | None]:
    """For each state before (4) and after (4) the stretch, its lightest derivation. Insertions behind its last row belong to what follows."""
    found: list[tuple[int, str] | None] = [None] * 16
    for q in range(4):
        items = derive(marks, (q,), None, False)
        for p in range(4):
            if (0, p) in items:
                found[p * 4 + q] = items[0, p][0], read_audit(items, p, len(marks))[0]
    return found


def join_stretches(stretches: list[list[tuple[int, str] | None]]) -> tuple[int, list[str]]:
    """Cost and audits of the lightest way through all stretches, from the grammar's start to one of its ends.

    Two derivations of a stretch end with a row of it, so none is the beginning of another one and equal costs are told apart by their audits alone.
    """
    rest = derive("", (START, ASSISTANT), None)
    tails = [(rest[0, q][0], read_audit(rest, q, 0)[0]) for q in range(4)]
    costs = [t[0] for t in tails]
    chosen: list[list[tuple[int, str, int]]] = []
    for stretch in reversed(stretches):
        best = [min((w[0] + costs[q], w[1], q) for q in range(4) if (w := stretch[p * 4 + q])) for p in range(4)]
        costs = [b[0] for b in best]
        chosen.append(best)
    state, audits = START, []
    for best in reversed(chosen):
        _, audit, state = best[state]
        audits.append(audit)
    return costs[START], [*audits, tails[state][1]]


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by the hash of ``conv_id:turn``: rows lost, emptied, without full stops, repeated, or of the wrong role."""
    spoken = _spoken(conversations)
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    hit = F.crc32(name.cast("binary")) % 20
    return (
        spoken.withColumn("hit", hit)
        .where("hit <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def _spoken(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


_ORDER = ["conv_id", "turn", "role", "said"]  # nulls first
_SEGMENT = (
    "conv_id bigint, turn bigint, role string, said binary, least bigint, most bigint, last bigint, turns bigint, blank bigint, "
    "duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, costs array<bigint>, audits array<string>"
)


def _marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, said, blank, closed, n, first): equal rows counted; ``first`` if the role and text were not seen before."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        "role",
        _said(),
        (trimmed == "").alias("blank"),
        F.right(trimmed, F.lit(1)).isin(*CLOSING).alias("closed"),
    )
    counted = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("n"))
    earliest = counted.groupBy("conv_id", "said").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("earliest"))
    earliest = earliest.select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), F.col("earliest.turn").alias("_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said"))
    return counted.join(earliest, same).select(*counted.columns, F.col("turn").eqNullSafe(F.col("_turn")).alias("first"))


def _said() -> F.Column:
    return F.unhex(F.sha2(F.concat("role", F.lit(":"), "text").cast("binary"), 256)).alias("said")


class _Segment:
    """What a task has seen of one conversation."""

    def __init__(self, conv, turn, role, said):
        self.conv, self.turn, self.role, self.said = conv, turn, role, said
        self.least = self.most = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_initial = self.last_initial = None
        self.marks: list[str] = []
        self.rows = 0

    def add(self, turn, role, blank, closed, n, first) -> None:
        self.rows += n
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.last = turn
        initial = role[:1]
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += is_illegal(self.last_initial, initial)
        self.illegal += (n - 1) * is_illegal(initial, initial)
        self.last_initial = initial
        if blank:
            self.blank += n
            self.marks.append("-" * n)
            return
        self.duplicate += n - first
        if first:
            mark = initial if initial in INITIALS and initial else "x"
            self.truncated += not closed
            self.marks.append(mark if closed else mark.upper())
        self.marks.append("-" * (n - first))

    def row(self, whole: bool) -> tuple:
        marks = "".join(self.marks)
        weights = [repair_marks(marks)] if whole else stretch_weights(marks)
        costs, audits = zip(*(w or (None, None) for w in weights), strict=True)
        seen = (self.least, self.most, self.last, self.turns, self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.conv, self.turn, self.role, self.said, *seen, self.first_initial, self.last_initial, list(costs), list(audits))


def is_illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0

    def flush():
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight >= most_bytes:
            yield flush()
            held, weight = [], 0
    if held:
        yield flush()


def _segments(marked: DataFrame, longest: int) -> DataFrame:
    """Rows of ``_SEGMENT``: counts, costs and audits of each conversation, or of its stretches where a task or ``longest`` parts it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(_SEGMENT)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            segment, whole = None, False
            for conv, turn, role, said, blank, closed, n, first in _rows(batches, ["conv_id", "turn", "role", "said", "blank", "closed", "n", "first"]):
                if segment is None:
                    segment = _Segment(conv, turn, role, said)
                elif conv != segment.conv or segment.rows >= longest:
                    ended = conv != segment.conv
                    yield segment.row(whole and ended)
                    whole = ended  # the next one begins here; it is whole if it ends here, too
                    segment = _Segment(conv, turn, role, said)
                segment.add(turn, role, blank, closed, n, first)
            if segment is not None:
                yield segment.row(False)

        yield from _batches(found(), arrow)

    ordered = marked.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    return ordered.mapInArrow(run, schema)


class Summary:
    """Counts, cost and audit of one conversation, from its segments in order."""

    def __init__(self, conv, segments: list[dict]):
        self.conv = conv
        self.blank, self.duplicate, self.truncated, self.illegal = (
            sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal")
        )
        known = [s for s in segments if s["least"] is not None]
        turns = sum(s["turns"] for s in known)
        for a, b in zip(known, known[1:], strict=False):
            turns -= a["most"] == b["least"]
        self.gaps = known[-1]["most"] - known[0]["least"] + 1 - turns if known else 0
        for a, b in zip(segments, segments[1:], strict=False):
            self.illegal += is_illegal(a["last_initial"], b["first_initial"])
        if len(segments) == 1 and len(segments[0]["costs"]) == 1:
            self.cost, self.audits = segments[0]["costs"][0], segments[0]["audits"]
        else:
            weights = [[None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"], strict=True)] for s in segments]
            self.cost, self.audits = join_stretches(weights) if weights else (0, [])

    def turns(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """(edit, turn, role, text) of each row of the repaired conversation; ``rows`` are its (turn, role, text) in order."""
        state = START
        for letter in (x for audit in self.audits for x in audit):
            turn, role, text = (None, None, "") if letter == "I" else next(rows)
            if letter == "D":
                continue
            state = MOVES[state][role[:1]] if letter == "K" else TURNED[state]
            yield letter, turn, role if letter == "K" else ROLE[state], text


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Summary, Iterator[tuple]]]:
    """Each conversation's summary and the rows of its repair, to be read before the next one."""
    rows = _rows(batches, ["conv_id", "rank", "turn", "role", "text", "segment"])
    held = next(rows, None)
    while held is not None:
        conv, segments = held[0], []
        while held is not None and held[0] == conv and held[1] < 2:
            if held[1] == 1:
                segments.append(held[5])
            held = next(rows, None)

        def own():
            nonlocal held
            while held is not None and held[0] == conv:
                row = held[2:5]
                held = next(rows, None)
                yield row

        rest = own()
        summary = Summary(conv, segments)
        yield summary, summary.turns(rest)
        for _ in rest:  # rows behind the last edit: none, unless the reader stopped early
            pass


def _gathered(conversations: DataFrame, rows: DataFrame, longest: int) -> DataFrame:
    """Names (rank 0), segments (rank 1) and rows (rank 2) of each conversation, together and in order."""
    segments = _segments(_marked(rows), longest)
    fields = [f.name for f in segments.schema if f.name not in ("conv_id", "turn", "role", "said")]
    packed = segments.select("conv_id", F.lit(1).alias("rank"), "turn", "role", "said", F.lit(None).cast("string").alias("text"), F.struct(*fields).alias("segment"))
    empty = F.lit(None).cast(packed.schema["segment"].dataType).alias("segment")
    names = conversations.select("conv_id").distinct()
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "bigint"), ("role", "string"), ("said", "binary"), ("text", "string"))]
    named = names.select("conv_id", F.lit(0).alias("rank"), *blank, empty)
    visible = F.when(F.trim("text", F.lit(SPACES)) != "", F.col("text")).alias("text")
    texts = rows.select("conv_id", F.lit(2).alias("rank"), F.col("turn").cast("bigint").alias("turn"), "role", _said(), visible, empty)
    united = named.unionByName(packed).unionByName(texts)
    order = ["conv_id", "rank", "turn", "role", "said"]  # nulls first
    return united.repartition("conv_id").sortWithinPartitions(*order)


def _prepared(conversations: DataFrame) -> DataFrame:
    return conversations.withColumn("conv_id", F.col("conv_id").cast("bigint"))


def repaired_turns(conversations: DataFrame, longest: int = STRETCH_ROWS) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), turn (null if inserted), role and text of each row."""
    spoken = _spoken(_prepared(conversations))
    schema = "conv_id bigint, position bigint, edit string, turn bigint, role string, text string"
    arrow = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        found = ((s.conv, at, *row) for s, turns in _replayed(batches) for at, row in enumerate(turns))
        yield from _batches(found, arrow)

    return _gathered(spoken, spoken, longest).mapInArrow(run, schema)


def repair_report(conversations: DataFrame, damaged: DataFrame | None = None, longest: int = STRETCH_ROWS) -> DataFrame:
    """One row for each conversation: gaps, faults, cost and audit of its lightest repair, digest of the repaired rows.

    ``damaged`` are the rows to repair, where they are not those of ``conversations`` itself.
    """
    conversations = _prepared(conversations)
    rows = _spoken(conversations if damaged is None else _prepared(damaged))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in counts) + ", audit string, repaired_sha256 string"
    arrow = pa.schema([(c, pa.int64()) for c in ("conv_id", *counts)] + [("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        def found():
            for summary, turns in _replayed(batches):
                digest = hashlib.sha256()
                for at, (_, _, role, text) in enumerate(turns):
                    digest.update(("\n" * (at > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                yield summary.conv, *(getattr(summary, c) for c in counts), "".join(summary.audits), digest.hexdigest()

        yield from _batches(found(), arrow)

    return _gathered(conversations, rows, longest).mapInArrow(run, schema)
