from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from periodica.llm import sharding as S
from tests.llm.frames import SMALL, needs_tables, no_documents, odd_documents


@pytest.mark.parametrize("seed", range(10))
def test_best_fit_equals_a_plain_search(seed):
    rng = random.Random(seed)
    capacity = 100
    sizes = sorted((rng.randint(1, 70) for _ in range(300)), reverse=True)
    rooms, want = [], []
    for size in sizes:
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if not fitting:
            rooms.append(capacity)
            fitting = [(capacity, len(rooms) - 1)]
        where = min(fitting)[1]
        rooms[where] -= size
        want.append(where)
    assert S.best_fit(sizes, capacity) == want


def test_tree_stays_balanced_and_finds_the_tightest():
    rng, tree, held = random.Random(1), S.Rooms(), set()
    for _ in range(4000):
        key = (rng.randint(0, 500), rng.randint(0, 9))
        if key in held and rng.random() < 0.7:
            tree.remove(key)
            held.discard(key)
        elif key not in held:
            tree.add(key)
            held.add(key)
        size = rng.randint(0, 510)
        assert tree.tightest(size) == min((k for k in held if k[0] >= size), default=None)

    def height(n):
        return 1 + max(height(n[2]), height(n[3])) if n else 0

    assert height(tree.root) <= 2 * len(held).bit_length()


def test_smallest_capacity():
    assert S.pack([], 3) == []
    sizes = sorted([7, 5, 5, 4, 4, 3, 2], reverse=True)
    totals = Counter()
    for size, where in zip(sizes, S.pack(sizes, 3), strict=True):
        totals[where] += size
    assert max(totals.values()) == 10


def test_a_group_beyond_an_even_share_stays_alone():
    sizes = [900, 500] + [10] * 60
    totals = Counter()
    for size, where in zip(sizes, S.pack(sizes, 5), strict=True):
        totals[where] += size
    assert sorted(totals.values()) == [200, 200, 200, 500, 900]
    assert S.pack([5, 4], 4) == [0, 1]


def check(rows, texts, shards):
    """Whole groups, gapless slots, sizes and checksums; the shards' bytes."""
    assert len(rows) == len(texts)
    where, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for shard, found in slots.items():
        assert sorted(found) == list(range(len(found))), shard
    checks = Counter((str(r.doc_id), r.size, r.text_crc32) for r in rows)
    assert checks == Counter((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    by_id = defaultdict(list)
    for d, t in texts:
        by_id[str(d)].append(t or "")
    for r in rows:
        if len(set(by_id[str(r.doc_id)])) == 1:
            where[by_id[str(r.doc_id)][0]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    return load


def test_odd_frames(spark, monkeypatch):
    odd = odd_documents(spark)
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    for rows_per_task in (200_000, 1):
        monkeypatch.setattr(S, "SLOT_ROWS", rows_per_task)
        got = S.with_shards(odd, 3)
        assert set(odd.columns) <= set(got.columns)
        check(got.collect(), texts, 3)
    assert S.with_shards(no_documents(spark)).count() == 0


@needs_tables
def test_query(spark):
    from periodica.llm.queries import op10_best_fit_shards

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    load = check(op10_best_fit_shards(spark, SMALL).collect(), texts, 40)
    largest = max(len(t.encode()) + 16 for _, t in texts)
    assert max(load.values()) <= max(2 * largest, 1.1 * sum(load.values()) / 40)
