from __future__ import annotations

import zlib

import numpy as np

from periodica.llm import quality as Q
from tests.llm.frames import LARGE, needs_tables, no_documents, odd_documents


def test_passages():
    assert Q.passages("").shape == (1, Q.WIDTH) and Q.passages(None).shape == (1, Q.WIDTH)
    text = "word " * Q.PASSAGE + "SHOUT!! " * 3
    bag = Q.passages(text)
    assert bag.shape == (2, Q.WIDTH)
    shape = bag[:, -Q.SHAPES :]
    np.testing.assert_allclose(shape[:, 1], [(Q.PASSAGE - 1) / Q.PASSAGE, 2 / 3], atol=1e-6)  # the word before, again
    np.testing.assert_allclose(shape[:, 2], [1 / Q.PASSAGE, 1 / 3], atol=1e-6)  # distinct words
    for odd in ["a", " a", "a ", "\n\n", "é😀 x", "a b " * 500]:
        assert np.isfinite(Q.passages(odd)).all()


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(2)
    x, starts, target = rng.random((7, Q.WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    model = Q.BagModel(np.zeros(Q.WIDTH), np.ones(Q.WIDTH), rng)

    def loss():
        y = model.forward(x, starts)["y"]
        return -(target * np.log(y) + (1 - target) * np.log(1 - y)).mean()

    gradients = model.backward(model.forward(x, starts), target, starts)
    for name, g in gradients.items():
        flat = model.p[name].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-6, name


def test_odd_frames(spark):
    odd = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(None, 1, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    model = Q.fit(odd, labels)
    rows = Q.with_scores(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert Q.with_scores(no_documents(spark), model).count() == 0
    assert {r.score for r in Q.with_scores(odd, Q.fit(odd, labels.limit(0))).collect()} == {0.5}


@needs_tables
def test_held_out_fold(spark):
    from periodica.llm.queries import op6_attention_quality

    rows = op6_attention_quality(spark, LARGE).toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(rows.doc_id, rows.held_out, strict=True))
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").toPandas()
    unseen = rows[rows.held_out].merge(labels, on="doc_id")
    assert (unseen.predicted == unseen.quality).mean() > 0.97
