from __future__ import annotations

import re

import pytest
import xxhash

from periodica.llm import simhash as S
from periodica.llm.common import cut
from tests.llm.frames import MEDIUM, SMALL, needs_tables, no_documents, odd_documents


def slow_fingerprint(text, width=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs_of_ids_and_fps, limit=4):
    """Smallest id reachable, for each position; None counts as the largest id."""
    n = len(pairs_of_ids_and_fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(pairs_of_ids_and_fps[i][1] ^ pairs_of_ids_and_fps[j][1]).count("1") <= limit:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs_of_ids_and_fps):
        least[find(i)] = min(least.get(find(i), S.NO_ID), S.NO_ID if doc is None else doc)
    return [least[find(i)] for i in range(n)]


def check(rows, texts_by_row):
    fps = [(doc, slow_fingerprint(text)) for doc, text in texts_by_row]
    want = sorted((str(doc), fp, c) for (doc, fp), c in zip(fps, slow_components(fps), strict=True))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), S.NO_ID if r.component_id is None else r.component_id) for r in rows)
    assert got == want


def test_fingerprint():
    for text in ["", " ", None, "a", "A b", "a b c d", "a b c d e\nf  g", "ÄÖÜ ä ö ü ß", "a\x0bb\x1cc d e f", "w " * 3000 + "x y z"]:
        assert S.fingerprint(text) == slow_fingerprint(text)


def test_chains_and_distances(spark):
    base = 0x0123456789ABCDEF
    fps = [base]
    for step in ([0], [0, 1, 2, 3], [5, 20, 40, 63], [6, 7, 8, 9, 10]):
        fps.append(fps[-1] ^ sum(1 << b for b in step))
    fps += [base ^ (1 << 63) ^ 1, base ^ 0xF0F0, 0, 15, 31 << 40]
    frame = spark.createDataFrame([(S._signed(f),) for f in set(fps)], "fp bigint")
    got = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in S.links(frame).collect()}
    want = {tuple(sorted((x, y))) for x in set(fps) for y in set(fps) if x < y and bin(x ^ y).count("1") <= 4}
    assert got == want
    with pytest.raises(ValueError, match="blocks"):
        S.links(frame, 5)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100}


def test_classes_are_not_broadcast(spark, monkeypatch):
    plans = []

    def kept(frame, name):
        plans.append((name, frame._jdf.queryExecution().executedPlan().toString()))
        return cut(frame, name)

    monkeypatch.setattr(S, "cut", kept)
    for name, found in (("result", S.near_duplicates(odd_documents(spark))), ("kept", S.keep_one_each(odd_documents(spark)))):
        plans.append((name, found._jdf.queryExecution().executedPlan().toString()))
    assert {"links", "edges", "linked", "members", "result", "winners", "kept"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []


def test_odd_frames(spark):
    odd = odd_documents(spark)
    check(S.near_duplicates(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    kept = S.keep_one_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 8, 9]
    assert S.near_duplicates(no_documents(spark)).count() == 0
    assert S.keep_one_each(no_documents(spark)).count() == 0


def test_rows_without_ids(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words here now"), (4, "third text of words")], "doc_id bigint, text string")
    assert sorted(str(r.text) for r in S.keep_one_each(frame).collect()) == ["a b c d e f", "other words here now", "third text of words"]


def test_two_texts_under_one_id(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g h"), (1, "other words here now and then"), (2, "other words here now and then")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in S.keep_one_each(frame).collect()) == sorted((r.doc_id, r.text) for r in frame.limit(2).collect())


@needs_tables
@pytest.mark.parametrize("sf_dir", [SMALL, MEDIUM])
def test_query_equals_brute_force(spark, sf_dir):
    from periodica.llm.queries import op2_simhash_near_duplicates

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    fps = [(d, slow_fingerprint(t)) for d, t in docs]
    want = sorted((d, f"{fp:016x}", c) for (d, fp), c in zip(fps, slow_components(fps), strict=True))
    rows = op2_simhash_near_duplicates(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want
