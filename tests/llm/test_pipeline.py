from __future__ import annotations

import pytest

import corpus_pipeline
from periodica.llm.common import shared_folder
from tests.llm import test_decontaminate, test_sharding, test_simhash
from tests.llm.frames import MEDIUM, needs_tables, no_documents, odd_documents


@needs_tables
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, MEDIUM), "test")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert len(kept[name]) == docs.count()
        if name != "sharding":
            assert docs.columns == columns
    toxic, near, clean, mixed, sharded = kept.values()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    # Some documents labelled toxic hold no word that marks the others.
    gone = {t: sum(d not in toxic for d in labels if labels[d] == t) / sum(labels[d] == t for d in labels) for t in (0, 1)}
    assert gone[1] > 0.85 and gone[0] < 0.01
    fps = [(d, test_simhash.slow_fingerprint(r.text)) for d, r in toxic.items()]
    assert set(near) == set(test_simhash.slow_components(fps))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    hits = test_decontaminate.slow([r.text for r in near.values()], items)
    assert set(clean) == {d for d, (_, hit, _) in zip(near, hits, strict=True) if not hit}
    assert 0 < len(mixed) < len(clean) and set(mixed) <= set(clean)
    assert set(sharded) == set(mixed)
    test_sharding.check(list(sharded.values()), [(d, r.text) for d, r in mixed.items()], 40)


@needs_tables
@pytest.mark.parametrize("frame", [odd_documents, no_documents])
def test_stages_take_odd_frames(spark, frame):
    docs = frame(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, MEDIUM), "test")
        assert name == "sharding" or docs.columns == columns


@needs_tables
def test_columns_of_any_name(spark):
    """Names with dots, names that differ from those of outputs by case, names like those used inside."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string, SHARD string, _won_text string, won_key string, `_in_0` string, Spans string, Severity string"
    rows = [(i, f"word{i} " * (i % 7 + 1) + f"and {i}", "en", "s", 1, *"abcdefg") for i in range(60)]
    docs = spark.createDataFrame(rows, schema)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, MEDIUM), "test")
        if name != "sharding":
            assert docs.columns == columns
            assert {tuple(r)[5:] for r in docs.collect()} == {tuple("abcdefg")}
    assert [c for c in columns if c != "SHARD"] == docs.columns[: len(columns) - 1] and "shard" in docs.columns


@needs_tables
def test_run(spark):
    assert "shard" in corpus_pipeline.run(spark, MEDIUM).columns


def test_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
