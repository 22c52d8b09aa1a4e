"""Searches through the dictionary of codes: the same rows, without a LIKE on the fact."""

from __future__ import annotations

import pytest

from periodica.operators import search
from periodica.sources import build_codes, read_codes, read_facts, refresh_codes, replace_period, rows_with_codes, write_facts
from periodica.spec import DEFAULT_SPEC
from tests.conftest import rows


@pytest.fixture
def tables(spark, facts, tmp_path):
    fact, codes = str(tmp_path / "fato"), str(tmp_path / "codigos")
    data = [(m, f"H-D/{i} FL{'HX' if i % 7 == m else 'TR'}", 2000 + i % 5, i, "SP" if i % 2 else "RJ") for m in range(1, 6) for i in range(60)]
    write_facts(facts(*data, (3, "h-d/flhx", None, 5), (4, None, 2001, 6)), fact)
    build_codes(read_facts(spark, fact), codes)
    return fact, codes


def same(left, right):
    assert sorted(map(repr, rows(left))) == sorted(map(repr, rows(right)))


@pytest.mark.parametrize("listed", [0, 3, 200])
@pytest.mark.parametrize("pattern", ["%flhx%", "%", "nothing", "h-d/_ FLTR", "%5%"])
def test_rows_are_the_same(spark, tables, pattern, listed):
    fact, codes = read_facts(spark, tables[0]), read_codes(spark, tables[1])
    got = rows_with_codes(fact, codes, pattern, listed=listed)
    assert got.columns == fact.columns
    same(got.select(DEFAULT_SPEC.row_columns), search.search_rows(fact, pattern, ordered=False))


def test_operators_take_the_codes(spark, tables):
    fact, codes = read_facts(spark, tables[0]), read_codes(spark, tables[1])
    for operator, arguments in (
        (search.search_rows, ("%flhx%",)),
        (search.family_like, ("%flhx%",)),
        (search.family_series, ("%flhx%",)),
        (search.search_slice, ("flhx", "2024-04-01", (2001, 2002), ("SP",))),
        (search.search_slice, ("f", "2024-04-01")),
    ):
        assert rows(operator(fact, *arguments, codes=codes)) == rows(operator(fact, *arguments))


@pytest.mark.parametrize("places", [1, 20])
def test_row_groups_without_the_codes_are_skipped(spark, facts, tmp_path, places):
    """H-D/1 FLHX is of the first month only, but lies between other codes of each.

    Codes of one row each are found by the Bloom filters of the row groups, codes of many rows by their dictionaries.
    """
    data = [(m, f"H-D/{i} FL{'HX' if i % 7 == m else 'TR'}", 2000, i, "SP", f"C{c}") for m in range(1, 6) for i in range(60) for c in range(places)]
    path = str(tmp_path / "fato")
    write_facts(facts(*data), path)
    build_codes(read_facts(spark, path), str(tmp_path / "codigos"))
    fact, codes = read_facts(spark, path), read_codes(spark, str(tmp_path / "codigos"))
    for found in (search.search_rows(fact, "h-d/1 flhx", ordered=False, codes=codes), fact.filter("marca_modelo = 'H-D/1 FLHX'")):
        plan = found._jdf.queryExecution().executedPlan()
        assert "LIKE" not in plan.toString().upper() and "lower(" not in plan.toString()
        assert len(found.collect()) == places
        scan = plan.collectLeaves().apply(0)
        assert scan.metrics().apply("numOutputRows").value() == 60 * places < fact.count()


def test_loads_refresh_the_codes(spark, facts, tables):
    fact_path, code_path = tables
    replace_period(facts((2, "H-D/NOVO FLHX", 2020, 1)), fact_path, "2024-02-01")
    replace_period(facts((9, "H-D/NOVE FLHX", 2020, 1)), fact_path, "2024-09-01")
    replace_period(facts((3, "x", 2020, 1)).limit(0), fact_path, "2024-03-01")
    fact = read_facts(spark, fact_path)
    refresh_codes(fact, code_path, ["2024-02-01", "2024-09-01", "2024-03-01"])
    codes = read_codes(spark, code_path)
    same(codes, fact.select("competencia", "marca_modelo").distinct().select(*codes.columns))
    same(search.search_rows(fact, "%flhx%", codes=codes), search.search_rows(fact, "%flhx%"))
