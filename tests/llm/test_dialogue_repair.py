from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from periodica.llm import dialogue_repair as R
from tests.llm.frames import MEDIUM, needs_tables

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def slow_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        hit = zlib.crc32(name.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        yield from [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


def slow_report(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of one conversation: all edits of every row are tried."""
    rows = [(turn, *(" " if v is None else v for v in (role, text))) for turn, role, text in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}:{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))

    @cache
    def best(i, output, inserts):
        """Cost, audit and repaired rows from row i on, after rows whose initials are like ``output``."""
        found = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", output):
            found.append((0, "", ()))
        if inserts < 3:
            found += [(c + 3, "I" + a, (f"{r}:", *x)) for r in ("user", "assistant") for c, a, x in step(i, output, r[0], inserts + 1)]
        if i < len(rows):
            _, role, text = rows[i]
            found += [(c + 4, "D" + a, x) for c, a, x in best(i + 1, output, 0)]
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                found += [(c + late, "K" + a, (f"{role}:{text}", *x)) for c, a, x in step(i + 1, output, role[:1], 0)]
                found += [(c + 3 + late, "R" + a, (f"{r}:{text}", *x)) for r in ("user", "assistant") for c, a, x in step(i + 1, output, r[0], 0)]
        return [min(found)] if found else []

    def step(i, output, initial, inserts):
        output += initial or " "  # an empty role fits nowhere
        if not re.fullmatch("s?(ua)*u?", output):
            return []
        return best(i, re.sub("(ua)+", "ua", output), inserts)  # pairs are alike

    cost, audit, repaired = best(0, "", 0)[0]
    digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def slow(conversations, damaged):
    grouped = {conv: [] for conv, *_ in conversations}
    for conv, *row in damaged:
        grouped[conv].append(row)
    return {conv: slow_report(rows) for conv, rows in grouped.items()}


def collected(frame):
    rows = frame.collect()
    got = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def drawn(rng, conversations, most):
    texts = ["Yes.", "no", "What?", " \n", "", None, "ok!  ", "é", "tail.\u0085", "x" * 30]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "umpire"]
    rows = []
    for conv in conversations:
        for turn in range(rng.randint(0, most)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{turn}."))
    return rows


def test_agenda_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        marks = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(0, 9)))
        rows = [(i, {"s": "system", "u": "user", "a": "assistant"}.get(m.lower(), "x"), "" if m == "-" else f"{i}" + "." * m.islower()) for i, m in enumerate(marks)]
        want = slow_report(rows)[5:7]
        assert R.repair_marks(marks) == want
        # Stretches of the rows, cut anywhere, give the same.
        cuts = sorted(rng.randint(0, len(marks)) for _ in range(3))
        parts = [marks[a:b] for a, b in zip([0, *cuts], [*cuts, len(marks)], strict=True)]
        cost, audits = R.join_stretches([R.stretch_weights(p) for p in parts if p])
        assert (cost, "".join(audits)) == want


def test_long_conversations():
    marks = "suauaUa-uauxaau" * 2000
    cost, audit = R.repair_marks(marks)
    parts = [marks[i : i + 1000] for i in range(0, len(marks), 1000)]
    joined_cost, audits = R.join_stretches([R.stretch_weights(p) for p in parts])
    assert (cost, audit) == (joined_cost, "".join(audits))


@pytest.mark.parametrize(("seed", "partitions"), [(1, 1), (2, 3), (3, 40)])
def test_report_equals_brute_force(spark, seed, partitions):
    """One conversation holds most rows, and many tasks part it."""
    rng = random.Random(seed)
    rows = drawn(rng, [*range(30), None, *[99] * 12], 12)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert collected(R.repair_report(frame)) == slow(rows, rows)
        assert collected(R.repair_report(frame, longest=1 + seed)) == slow(rows, rows)
        assert collected(R.repair_report(frame, R.damage(frame))) == slow(rows, list(slow_damage(rows)))
        turns = R.repaired_turns(frame, longest=3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    said = {}
    for r in sorted(turns, key=lambda r: r.position):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    want = slow(rows, rows)
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in said.items()} == {c: w[-1] for c, w in want.items() if c in said}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in s)) for s in said.values())


def test_odd_frames(spark):
    empty = hashlib.sha256(b"").hexdigest()
    clash = "conv_id int, turn int, role string, text string, rank string, said string, `a.b` string, SEGMENT string, hit int"
    none = spark.createDataFrame([], clash)
    assert R.repair_report(none, R.damage(none)).count() == 0 and R.repaired_turns(none).count() == 0
    long = "word " * 200_000
    rows = [(1, 0, "user", long + ".", *["x"] * 4, 1), (1, 1, "assistant", long, *["x"] * 4, 1), (2, None, None, None, *["x"] * 4, 1)]
    frame = spark.createDataFrame(rows, clash)
    digest = hashlib.sha256(f"user:{long}.\nassistant:{long}".encode()).hexdigest()
    assert collected(R.repair_report(frame)) == {1: (0, 0, 0, 1, 0, 3, "KK", digest), 2: (0, 1, 0, 0, 0, 4, "D", empty)}
    assert collected(R.repair_report(frame, frame.limit(0))) == dict.fromkeys((1, 2), (0, 0, 0, 0, 0, 0, "", empty))
    assert R.repaired_turns(frame).count() == 2
    same = spark.createDataFrame([(7, 3, "user", "a.")] * 500 + [(7, 4, "assistant", "b.")], SCHEMA)
    got = collected(R.repair_report(same))[7]
    assert got[:6] == (0, 0, 499, 0, 499, 4 * 499) and got[6] == "K" + "D" * 499 + "K"


@needs_tables
def test_query_equals_brute_force(spark):
    from periodica.llm.queries import op13_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = collected(op13_conversation_repair(spark, MEDIUM))
    assert got == slow(rows, list(slow_damage(rows)))
    assert all(any(r[k] for r in got.values()) for k in range(6))
