from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest

from periodica.llm import filter_audit as A
from tests.llm.frames import MEDIUM, needs_tables, no_documents, odd_documents

SPACE = b" \t\n\v\f\r"


def slow_counts(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall(rb"[A-Z]", text)), len(text.decode()), len(re.findall(rb"[#$%&*|]", text))]


def slow_audit(docs, labels):
    """The rows of the audit, by applying the filters in every order to every document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for doc, text, source in docs:
        text = text or ""
        n, distinct, capitals, points, symbols = slow_counts(text.encode())
        copy = doc is not None and any((t or "") == text and d is not None and d < doc for d, t, _ in docs)
        fails = dict(zip("ABCDE", [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * points, symbols > 0, copy], strict=True))
        parts.setdefault(source or "", []).append((doc, {f for f, bad in fails.items() if bad}))
    rows = {}
    for part, members in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                lost = [d for d, bad in members if f in bad and not bad & before]
                removed_by[f] += len(lost)
                rows[part, order, step] = [
                    sum(not bad & (before | {f}) for _, bad in members),
                    len(lost),
                    sum(f in bad and bool(bad & before) for _, bad in members),
                    sum(bad == {f} for _, bad in members),
                    sum(d in good for d in lost),
                    sum(d in toxic for d in lost),
                ]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in rows.items()}


@pytest.mark.parametrize("piece", [1, 3, 64, A.PIECE_BYTES])
def test_transducer_equals_plain_counts(piece):
    rng, table = random.Random(piece), A.WordTable()
    letters = "ab A\n\tZ#é–😀\u00a0\u0085|"
    texts = [b"", b" ", "é".encode(), b"x" * 300, b"a " * 200]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))).encode() for _ in range(200)]
    assert A.text_counts(texts, table, piece) == [slow_counts(t) for t in texts]


def test_colliding_hashes_are_told_apart():
    class Colliding(A.WordTable):
        def hashes(self, data, starts, ends):
            return np.zeros(len(starts), np.uint64)

        def first_of_each(self, data, owner, starts, ends):
            return super().first_of_each(data, np.zeros_like(owner), starts, ends)

    words = b"aa bb aa cc bb dd aa"
    data, bounds = np.frombuffer(words, np.uint8), np.array([0, len(words)])
    assert A.transduce(data, bounds, Colliding())[1].tolist() == [4]


@pytest.mark.parametrize("partitions", [1, 5])
def test_audit_equals_brute_force(spark, partitions):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "d#", "é", "zz", "yy", "xx"]
    texts = [" ".join(rng.choice(words[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 80))) for _ in range(40)] + [None, "", "\u00a0"]
    texts += [" ".join(f"w{i}" for i in range(60))]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(150)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(partitions)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = A.filter_interactions(frame, marks).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows) == 600 * 3
    assert got == slow_audit(docs, labels)


def test_odd_frames(spark):
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = odd_documents(spark)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in A.filter_interactions(odd, marks).collect()}
    assert got == slow_audit([(r.doc_id, r.text, r.source) for r in odd.collect()], [])
    assert A.filter_interactions(no_documents(spark), marks).count() == 0
    clash = spark.createDataFrame([(1, "x", "s", 1, 2)], "doc_id int, text string, source string, N_WORDS int, `a.b` int")
    assert A.with_counts(clash).columns == ["doc_id", "text", "source", "a.b", "n_words", "n_distinct", "n_capitals", "n_codepoints", "n_symbols", "digest"]
    assert A.filter_interactions(clash, marks).count() == 600


@needs_tables
def test_query_equals_brute_force(spark):
    from periodica.llm.queries import op12_filter_interactions

    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in op12_filter_interactions(spark, MEDIUM).collect()}
    assert got == slow_audit(docs, labels)
