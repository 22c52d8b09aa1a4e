"""Small frames of documents with everything that real tables hold."""

from __future__ import annotations

import os

import pytest

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"

needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")

ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, spans string, severity string, n_tokens string, score string, shard string, key string, row string"


def odd_documents(spark):
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows and columns called like outputs."""
    long = "lorem ipsum dolor sit amet " * 20_000
    texts = {
        1: "one two three four five six seven eight nine ten eleven twelve",
        2: "one two three four five six seven eight nine ten eleven twelve",
        3: None,
        4: "",
        5: "  \t\n ",
        6: long,
        7: long,
        8: "Ünïcode ŸÉ words 12 and – dashes…",
        9: "x",
    }
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "a", None, *["clash"] * 8) for i, t in texts.items()]
    rows += [rows[0], (None, "one two three four five six seven eight nine ten eleven twelve", *[None] * 11), (None, None, *[None] * 11)]
    return spark.createDataFrame(rows, ODD_SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
