from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.llm import neighbours as N
from tests.llm.frames import LARGE, needs_tables

SCHEMA = "vec_id bigint, embedding array<float>, node string, score string"


def exact(rows, query, k=5):
    """(score, -id) of the nearest, nearest first."""
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    q = usable[query]
    scored = [(float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), -i) for i, v in usable.items() if i != query]
    return sorted(scored, reverse=True)[:k]


def test_odd_frames(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[50][1]) for i in range(40)]  # one very common vector
    rows += [(300, [2 * x for x in rows[50][1]]), (301, [0.0] * 6), (302, None), (303, []), (305, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(306, [float("nan")] * 6), (307, [float("inf")] * 6), (None, rows[3][1]), rows[7]]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = N.nearest(frame, F.col("vec_id") % 50 == 0, 5).toPandas()
    assert sorted(set(got.query_id)) == [0, 50, 100, 200, 300]
    hits = 0
    for query, found in got.sort_values("rank").groupby("query_id"):
        want = exact(rows, query)
        assert list(found["rank"]) == [1, 2, 3, 4, 5] and query not in set(found.vec_id)
        hits += len({-i for _, i in want} & set(found.vec_id))
        if query in (50, 200):
            assert list(found.vec_id) == [-i for _, i in want]
    assert hits >= 24
    few = N.nearest(frame.where("vec_id in (50, 51, 52)"), F.col("vec_id") % 50 == 0, 5).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r["rank"])] == [(50, 1), (50, 2)]
    assert N.nearest(frame.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert N.nearest(frame.where("vec_id = 301"), F.col("vec_id") % 50 == 0, 5).count() == 0


@needs_tables
def test_recall_of_the_query(spark):
    from periodica.llm.queries import op8_nn_descent

    table = spark.read.parquet(f"{LARGE}/embeddings.parquet").toPandas()
    x = np.stack(table.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    place = {v: i for i, v in enumerate(table.vec_id)}
    found = op8_nn_descent(spark, LARGE).toPandas()
    hits = total = 0
    for query, rows in found.groupby("query_id"):
        scores = x @ x[place[query]]
        np.testing.assert_allclose(rows.score, [scores[place[v]] for v in rows.vec_id], atol=1e-9)
        scores[place[query]] = -9
        hits += (rows.score >= np.sort(scores)[-5] - 1e-9).sum()
        total += 5
    assert total == 5 * (table.vec_id % 50 == 0).sum() and hits >= 0.9 * total


def recall(spark, x, every):
    """Share of the true five nearest that are found; all queries have five rows."""
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = N.nearest(frame, F.col("vec_id") % every == 0, 5).toPandas()
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for query, some in found.groupby("query_id"):
        scores = x @ x[query]
        scores[query] = -9
        assert len(some) == 5
        hits += len(set(np.argsort(-scores)[:5]) & set(some.vec_id))
    assert found.query_id.nunique() == len(range(0, len(x), every))
    return hits / (5 * found.query_id.nunique())


def test_recall_among_near_copies(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=12)
    copies = base + rng.normal(size=(3000, 12)) * 0.0005 * np.abs(base).max()
    assert recall(spark, np.concatenate((copies, rng.normal(size=(500, 12)))).astype(np.float32), 50) >= 0.9


def test_every_query_has_its_rows(spark, monkeypatch):
    """Nodes that are alone in all leaves, in a frame whose leaves are many."""
    monkeypatch.setattr(N, "LEAF", 1)
    rng = np.random.default_rng(6)
    assert recall(spark, rng.normal(size=(600, 8)).astype(np.float32), 3) >= 0.9


def test_scan_is_exact(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    x = np.random.default_rng(6).normal(size=(60, 8)).astype(np.float32)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node bigint, vec array<float>")
    short = points.where("node < 10").select(F.col("node").alias("query"), F.col("vec").alias("query_vec"))
    got = N._scan(short, points, 5).toPandas()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for query, some in got.groupby("query"):
        assert set(some.node) - {query} == {-i for _, i in exact(rows, query)}
    assert got["query"].nunique() == 10


def test_rounds_and_hops_fail_loudly(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(3000, 12)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    points = N.nodes(N.usable_vectors(frame), 5)
    with pytest.raises(RuntimeError, match="did not settle"):
        N.build_graph(points, rounds=1)
    queries = points.where("node < 20").select(F.col("node").alias("query"), F.col("vec").alias("query_vec"), F.col("node").alias("entry"))
    monkeypatch.setattr(N, "HOPS", 1)
    with pytest.raises(RuntimeError, match="waiting"):
        N.search(points, N.build_graph(points), queries, 5)
