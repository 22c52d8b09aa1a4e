from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from periodica.llm import mixing as M
from tests.llm.frames import MEDIUM, needs_tables, no_documents, odd_documents


def corpus(spark, n=6000):
    return spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("word "), (F.col("id") % 50 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        F.element_at(F.array(*map(F.lit, ["en", "en", "de", None])), (F.col("id") % 11 % 4 + 1).cast("int")).alias("lang"),
    )


def test_word_counts(spark):
    texts = ["", None, " ", "a", " a  b\n\tc ", "x\x0by", "é è"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(M.token_count().alias("n"))
    assert [r.n for r in frame.collect()] == [len((t or "").split()) for t in texts]


def test_margins_meet_the_targets(spark):
    cells = M._with_cells(corpus(spark)).groupBy(*M.MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    goals = {m: M.targets_by_temperature(cells, m, 0.5) for m in M.MARGINS}
    raked = M.rake(cells, goals, sweeps=30, tolerance=1e-6).toPandas()
    total = raked.tokens.sum()
    for margin, goal in goals.items():
        share = raked.groupby(margin).fitted.sum() / total
        for value, wanted in goal.collect():
            assert share[value] == pytest.approx(wanted, rel=1e-4)


def test_sample_follows_the_targets(spark):
    docs = corpus(spark, 40_000)
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("de", 0.3), (M.NULL_VALUE, 0.2)], "value string, share double")}
    drawn = M.mix(docs, {"source": 1.0, "topic": 1.0}, targets).groupBy("lang").agg(F.sum("tokens").alias("n")).toPandas()
    share = drawn.set_index("lang").n / drawn.n.sum()
    assert share["en"] == pytest.approx(0.5, abs=0.02)
    assert share["de"] == pytest.approx(0.3, abs=0.02)


def test_value_without_target_goes(spark):
    targets = {"source": spark.createDataFrame([("big", 1.0), ("absent", 1.0)], "value string, share double")}
    assert {r.source for r in M.mix(corpus(spark), targets=targets).select("source").distinct().collect()} == {"big"}


@pytest.mark.parametrize("lone", [False, True])
def test_kept_share_is_as_stated(spark, lone):
    """A source of a third of the rows, and one of a single document: neither decides how much stays."""
    docs = corpus(spark, 40_000)
    if lone:
        docs = docs.withColumn("source", F.when(F.col("doc_id") == 17, "lone").otherwise(F.col("source")))
    drawn = M.mix(docs)
    whole = docs.agg(F.sum(M.token_count())).first()[0]
    assert drawn.agg(F.sum("tokens")).first()[0] / whole == pytest.approx(M.KEPT, abs=0.02)
    few = M.mix(docs, kept=0.1).agg(F.sum("tokens")).first()[0]
    assert few / whole == pytest.approx(0.1, abs=0.02)
    assert drawn.where("row.source = 'lone'").count() == lone


def test_odd_frames(spark):
    odd = odd_documents(spark)
    got = M.mix(odd).select("row.*")
    assert got.columns == odd.columns
    rows = [tuple(r) for r in got.collect()]
    assert 0 < len(rows) <= odd.count()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in M.mix(odd).select("row.*").collect())
    assert M.mix(no_documents(spark)).count() == 0
    narrow = M.mix_without_texts(odd).select("row.*", "topic", "tokens", "probability")
    whole = M.mix(odd).select("row.*", "topic", "tokens", "probability").drop("text")
    assert narrow.columns == whole.columns
    assert sorted(map(repr, narrow.collect())) == sorted(map(repr, whole.collect()))


@needs_tables
def test_query_is_native(spark):
    from periodica.llm.queries import op3_mix_to_targets

    frame = op3_mix_to_targets(spark, MEDIUM)
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
    assert 0 < frame.count() < 1000
