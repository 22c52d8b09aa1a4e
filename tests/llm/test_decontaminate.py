from __future__ import annotations

import hashlib
import random
import re

import pytest

from periodica.llm import decontaminate as D
from tests.llm.frames import MEDIUM, needs_tables, no_documents, odd_documents


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def slow(texts, items, window=10):
    """n_words, n_hit and the items, by comparing every window with every place."""
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = sorted({len(k) for k in windows})
    for text in texts:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        yield len(w), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(15))
def test_automaton_equals_brute_force(seed):
    rng = random.Random(seed)
    window = rng.choice([2, 3, 10])

    def draw(n):
        return " ".join(rng.choice("abcd") for _ in range(n))

    items = [(i, draw(rng.randint(0, 2 * window))) for i in range(12)]
    texts = [draw(rng.randint(0, 60)) + " z " + rng.choice(items)[1] for _ in range(20)]
    automaton = D.ItemAutomaton(items, window)
    for text, (n, hit, found) in zip(texts, slow(texts, items, window), strict=True):
        spans, got = automaton.scan(D.words_of(text))
        assert (len(D.words_of(text)), sum(b - a + 1 for a, b in spans), sorted(map(str, got))) == (n, hit, found)
        assert spans == sorted(spans)


def odd_items(spark):
    rows = [(1, "two three four five six seven eight nine ten eleven"), (1, "X"), (2, None), (3, "--"), (12, "ünïcode Ÿé"), (None, "dolor sit")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "item_id bigint, text string, n_words string")


@pytest.mark.parametrize("bound", [16 << 20, 20])
def test_odd_frames(spark, monkeypatch, bound):
    monkeypatch.setattr(D, "AUTOMATON_BYTES", bound)  # the small bound makes several automata
    odd, items = odd_documents(spark), odd_items(spark)
    found = D.count_hits(D.find_contamination(odd, items))
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    known = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
    known += [("", "")]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect())
    nameless = {"dolor", "sit"}
    want = []
    for (doc, text), (n, hit, names) in zip(texts, slow([t for _, t in texts], known), strict=True):
        if nameless <= set(words(text)):  # items without an id are one item, without a name
            hit, names = 40_000, [None]
        want.append((str(doc), n, hit, len(names), hit > 0))
    assert got == sorted(want)
    kept = D.drop_contaminated(odd, items)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "8", "None"]
    assert D.count_hits(D.find_contamination(no_documents(spark), items)).count() == 0
    assert D.drop_contaminated(odd, items.limit(0)).count() == odd.count()


def test_limits_and_span_removal(spark):
    docs = spark.createDataFrame([(1, "Keep this: the quick brown fox, jumps! And that."), (2, None), (3, "clean")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "The quick brown fox jumps")], "item_id bigint, text string")
    assert {r.doc_id: r.text for r in D.remove_spans(docs, items).collect()} == {1: "Keep this: ! And that.", 2: None, 3: "clean"}
    assert D.drop_contaminated(docs, items, max_coverage=0.6).count() == 3
    assert D.drop_contaminated(docs, items, min_words=6).count() == 3
    assert D.drop_contaminated(docs, items).count() == 2


@needs_tables
def test_query_equals_brute_force(spark):
    from periodica.llm.queries import op9_benchmark_decontamination

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    want = sorted(
        (doc, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
        for (doc, _), (n, hit, names) in zip(docs, slow([t for _, t in docs], items), strict=True)
    )
    got = op9_benchmark_decontamination(spark, MEDIUM)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[5] for r in want) > 10
