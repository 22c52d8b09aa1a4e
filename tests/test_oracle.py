"""Every keyed query against its SQL on the smallest test tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.keyed.queries(), entry.oracle.oracle_sql()

# Keys of one model or place that have no row at this scale; at the next they have.
THIN = {"model_by_uf", "model_by_city", "model_snapshot", "fleet_model_at_period", "search_slice_places"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    return duck(SF_DIR)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("key", QUERIES)
def test_query_matches_sql(spark, database, key):
    problem = compare(QUERIES[key](spark, SF_DIR), database.sql(SQL[key]))
    assert problem is None or problem == "both empty" and key in THIN


def test_entry_is_a_lazy_frame(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["competencia", "ano_fabricacao", "emplacamentos", "emplacamentos_total"]
    assert frame.count() > 0
