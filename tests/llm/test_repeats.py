from __future__ import annotations

import hashlib
import random

import pytest

from periodica.llm import repeats as R
from tests.llm.frames import SMALL, needs_tables, no_documents, odd_documents


def slow(docs, span=50):
    """Rows of the query, each window looked up in all documents."""
    seen = {}
    for doc, text in docs:
        doc = R.NO_ID if doc is None else doc
        for i in range(len(text) - span + 1):
            window = text[i : i + span]
            seen[window] = min(seen.get(window, R.NO_ID), doc)
    for doc, text in docs:
        gone = bytearray(len(text))
        for i in range(len(text) - span + 1):
            if seen[text[i : i + span]] < (R.NO_ID if doc is None else doc):
                gone[i : i + span] = b"\1" * span
        rest = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = len([run for run in bytes(gone).split(b"\0") if run])
        yield doc, len(text), sum(gone), spans, hashlib.sha256(rest).hexdigest()


def same(frame, docs, span=50):
    got = sorted(map(str, (tuple(r) for r in frame.collect())))
    assert got == sorted(map(str, slow(docs, span)))


@pytest.mark.parametrize("seed", range(12))
def test_buckets_equal_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    span = rng.choice([12, 20, 50])
    monkeypatch.setattr(R, "PIECE_BYTES", rng.choice([97, 1000, 2 << 20]))
    monkeypatch.setattr(R, "SORT_WINDOWS", rng.choice([1, 50, 10**6]))
    shared = [bytes(rng.choice(b"ab c") for _ in range(rng.randint(0, 160))) for _ in range(4)]
    docs = []
    for _ in range(25):
        parts = [rng.choice(shared)[rng.randint(0, 40) :] if rng.random() < 0.6 else bytes(rng.choice(b"abcde\0") for _ in range(rng.randint(0, 60))) for _ in range(3)]
        docs.append((rng.randint(0, 30), b"".join(parts)))
    packed = {}
    for at in range(0, 25, 7):
        held = [p for k, (d, t) in enumerate(docs[at : at + 7]) if len(t) >= span for p in R._pieces(d, at + k, t, span)]
        for bucket, runs in R.cut_runs(held, 3, span) if held else ():
            packed.setdefault(bucket, []).append(runs)
    gone = [bytearray(len(t)) for _, t in docs]
    for runs in packed.values():
        for doc, tag, first, end in zip(*R.bucket_ranges(runs, span), strict=True):
            assert docs[tag][0] == doc
            gone[tag][first:end] = b"\1" * (end - first)
    want = list(slow(docs, span))
    assert [(d, sum(g)) for (d, _), g in zip(docs, gone, strict=True)] == [(w[0], w[2]) for w in want]


def test_ranges_unite():
    import numpy as np

    assert R.merged(np.array([[5, 9], [0, 2], [2, 4], [8, 12], [20, 21]])) == [(0, 4), (5, 12), (20, 21)]
    assert R.merged(np.zeros((0, 2), int)) == []


def test_odd_frames(spark):
    odd = odd_documents(spark).where("doc_id is null or doc_id not in (6, 7)")
    passage = "a passage of well over fifty bytes that several documents share with each other; "
    more = spark.createDataFrame(
        [(20, "x " + passage * 2), (21, passage + "y"), (22, passage[:49]), (19, "z" * 120), (None, passage), (21, "z" * 70 + passage), (20, "z" * 60)],
        "doc_id bigint, text string",
    )
    frame = odd.select("doc_id", "text").union(more)
    same(R.remove_repeats(frame), [(r.doc_id, (r.text or "").encode()) for r in frame.collect()])
    assert R.remove_repeats(no_documents(spark)).count() == 0
    long = R.remove_repeats(odd_documents(spark).where("doc_id in (6, 7)")).collect()
    assert {(r.doc_id, r.n_bytes == r.n_removed) for r in long} == {(6, False), (7, True)}


def test_many_texts_of_one_id(spark):
    """Among 600 texts of one id, small hashes of texts meet; what is found in one must not be cut out of another."""
    passage = "a passage of well over fifty bytes that several documents share with each other; "
    rows = [(5, f"{i} " * 40 + passage * (i % 3 == 0) + f"{i}!" * 20) for i in range(600)] + [(1, passage)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in R.remove_repeats(frame).collect()}
    want = set()
    for i, (doc, text) in enumerate(rows):
        rest = text.replace(passage, "") if doc == 5 else text
        want.add((doc, len(text), len(text) - len(rest), hashlib.sha256(rest.encode()).hexdigest()))
    assert got == want


def test_kept_text(spark):
    frame = spark.createDataFrame([(1, "é" * 60), (2, "ab" + "é" * 60 + "cd")], "doc_id bigint, text string")
    assert {r.doc_id: bytes(r.kept) for r in R.remove_repeats(frame, keep_text=True).collect()} == {1: ("é" * 60).encode(), 2: b"abcd"}


@needs_tables
def test_query_equals_brute_force(spark):
    from periodica.llm.queries import op7_previous_factor_dedup

    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    same(op7_previous_factor_dedup(spark, SMALL), docs)
