from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from periodica.llm import toxicity as X
from tests.llm.frames import LARGE, needs_tables, no_documents, odd_documents


def labelled(spark, n=400):
    docs = spark.range(n).select(
        "id",
        F.concat(
            F.lit("plain words of a text "),
            F.when(F.col("id") % 4 == 0, F.repeat(F.lit("nasty slur "), (F.col("id") % 3 + 1).cast("int"))).otherwise(F.lit("kind ")),
            F.repeat(F.lit("filler "), (F.col("id") % 20).cast("int")),
        ).alias("text"),
    ).withColumnRenamed("id", "doc_id")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic"))
    return docs, labels


def test_thresholds_are_ordered_and_severity_expected(spark):
    docs, labels = labelled(spark)
    model = X.fit(docs, labels)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == X.GRADES
    low, high = model.exceed("plain words of a text kind filler"), model.exceed("nasty slur nasty slur nasty slur")
    assert low[0] < 0.5 < high[0]
    assert low == sorted(low, reverse=True) and high == sorted(high, reverse=True)
    assert model.exceed("a text with nastyish people")[0] > low[0]  # an unseen form of a known beginning


def test_fit_separates_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, X.GRADES + 1, 200)
    rows = np.arange(200)
    params, thresholds = X._minimise(rows, np.zeros(200, int), grades.astype(float), grades, 1)
    assert thresholds == sorted(thresholds) and np.isfinite(params).all()
    guessed = (params[0] * grades[:, None] > np.array(thresholds)[None, :]).sum(axis=1)
    assert (guessed == grades).mean() > 0.95


def test_odd_frames(spark):
    docs, labels = labelled(spark)
    model = X.fit(docs, labels)
    odd = odd_documents(spark)
    scored = X.with_severity(odd, model)
    assert sorted(scored.columns) == sorted(set(odd.columns) | {"severity", "toxic_probability", "is_toxic"})
    rows = scored.collect()
    assert len(rows) == odd.count() and all(0 <= r.severity <= X.GRADES for r in rows)
    kept = X.drop_toxic(odd, model)
    assert kept.schema.names == odd.schema.names
    assert X.drop_toxic(no_documents(spark), model).count() == 0
    nothing = X.fit(no_documents(spark), labels.limit(0))
    assert {r.severity for r in X.with_severity(odd, nothing).collect()} == {0.0}
    odd_labels = spark.createDataFrame([(1, None, 1), (1, None, 0), (None, 1, 1), (2, 1, None)], "doc_id bigint, quality int, toxic int")
    assert X.fit(odd, odd_labels).thresholds == []


@needs_tables
def test_unseen_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = X.fit(docs, labels, keep=~fold)
    scored = X.with_severity(docs.select("doc_id", "text"), model, drop=("text",)).join(labels.where(fold), "doc_id")
    n = scored.groupBy("toxic", "is_toxic").count().toPandas().set_index(["toxic", "is_toxic"])["count"]
    # Some labelled documents of these tables hold no word that any other toxic document holds.
    assert n.get((1, True), 0) >= 0.9 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.02 * n.get((0, False), 0)


def test_sample_is_bounded_when_ids_repeat(spark):
    """A labelled id that is repeated 10,000 times gives the sample one row."""
    docs = spark.range(10_100).selectExpr("least(id, 100) AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(200).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    rows = X.labelled_sample(docs, labels, "toxic", 150).collect()
    assert 0 < len(rows) <= 150 and len({r.doc_id for r in rows}) == len(rows)
    full = {r.doc_id: r.text for r in X.labelled_sample(docs, labels, "toxic", 1000).collect()}
    assert len(full) == 101 and full[100] == "text 100"
