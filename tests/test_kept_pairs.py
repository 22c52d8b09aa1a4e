"""A refreshed table of pairs equals the one that is built anew, and reads three periods."""

from __future__ import annotations

import random
import re
from datetime import date

import pytest

from periodica.operators.flow import annual_flow, base_builder_ranking
from periodica.operators.registrations import registrations, registrations_of_pairs
from periodica.plans import kept_pairs as K
from periodica.sources.facts import read_facts, replace_period, write_facts
from periodica.spec import DEFAULT_SPEC
from tests.conftest import rows


def month(m):
    return date(2024 + (m - 1) // 12, (m - 1) % 12 + 1, 1)


def drawn(rng, periods):
    return [
        (m, rng.choice(["A", "B", "C", "D", None]), rng.choice([2020, 2021, None]), rng.randint(0, 30), rng.choice(["SP", "RJ"]))
        for m in periods
        for _ in range(rng.randint(1, 8))
    ]


def same_rows(left, right):
    assert sorted(map(repr, rows(left))) == sorted(map(repr, rows(right)))


@pytest.fixture
def tables(spark, facts, tmp_path):
    """A fact without months 4 and 7, its pairs, and a function that loads a month and refreshes."""
    rng = random.Random(5)
    fact_path, pair_path = str(tmp_path / "fato"), str(tmp_path / "pares")
    write_facts(facts(*drawn(rng, [1, 2, 3, 5, 6, 8, 9])), fact_path)
    K.build_pairs(read_facts(spark, fact_path), pair_path)

    def load(*months, empty=False):
        for m in months:
            data = facts(*drawn(rng, [m]))
            replace_period(data.limit(0) if empty else data, fact_path, month(m))
        fact = read_facts(spark, fact_path)
        return K.refresh_pairs(fact, pair_path, [month(m) for m in months])

    return fact_path, pair_path, load


def check(spark, fact_path, pair_path):
    fact, pairs = read_facts(spark, fact_path), K.read_pairs(spark, pair_path)
    from periodica.operators.registrations import model_year_pairs

    same_rows(pairs, model_year_pairs(fact).select(pairs.columns))
    assert rows(registrations_of_pairs(pairs)) == rows(registrations(fact))
    assert rows(K.annual_flow_kept(pairs)) == rows(annual_flow(fact))
    assert rows(K.base_builder_kept(pairs)) == rows(base_builder_ranking(fact))
    assert K.stale_periods(fact, pairs).count() == 0


@pytest.mark.parametrize(
    ("months", "touched"),
    [
        ([5], [5, 6]),  # a middle month
        ([1], [1, 2]),  # the first
        ([9], [9]),  # the last
        ([4], [4, 5]),  # a missing one
        ([10], [10]),  # a new last one
        ([2, 4, 7], [2, 3, 4, 5, 7, 8]),  # several
    ],
)
def test_refresh_equals_build(spark, tables, months, touched):
    fact_path, pair_path, load = tables
    assert load(*months) == [month(m) for m in touched]
    check(spark, fact_path, pair_path)


def test_emptied_months_go(spark, tables):
    fact_path, pair_path, load = tables
    assert load(5, empty=True) == [month(6)]
    check(spark, fact_path, pair_path)
    assert load(9, empty=True) == []
    check(spark, fact_path, pair_path)
    assert load(1, empty=True) == [month(2)]
    check(spark, fact_path, pair_path)


def test_rerun_changes_nothing_and_bounds_prune(spark, tables):
    fact_path, pair_path, load = tables
    fact = read_facts(spark, fact_path)
    before = sorted(map(repr, rows(K.read_pairs(spark, pair_path))))
    K.refresh_pairs(fact, pair_path, [month(3), "2024-05-01"])
    assert sorted(map(repr, rows(K.read_pairs(spark, pair_path)))) == before
    bounded = registrations_of_pairs(K.read_pairs(spark, pair_path), since=month(3), until=month(6))
    assert rows(bounded) == rows(registrations(fact, since=month(3), until=month(6)))


def test_three_periods_are_read(spark, tables):
    fact_path, _, _ = tables
    fact = read_facts(spark, fact_path)
    touched, needed = K.affected_periods(K.observed_periods(fact), [month(5)])
    assert (touched, needed) == ([month(5), month(6)], [month(3), month(5), month(6)])
    plan = K.recomputed_pairs(fact, touched, needed)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    listed = f"{DEFAULT_SPEC.period}#\\d+ IN \\(2024-03-01,2024-05-01,2024-06-01\\)"
    assert scans and all(re.search(listed, line) for line in scans)


def test_stale_periods_are_found(spark, facts, tables):
    """Loads whose refresh was lost."""
    fact_path, pair_path, load = tables

    def stale():
        return [r[0] for r in K.stale_periods(read_facts(spark, fact_path), K.read_pairs(spark, pair_path)).collect()]

    replace_period(facts((5, "A", 2020, 999), (5, "B", None, 1)), fact_path, month(5))
    assert stale() == [month(5), month(6)]
    replace_period(facts((4, "A", 2020, 3)), fact_path, month(4))
    assert stale() == [month(4), month(5), month(6)]
    replace_period(facts((9, "A", 2020, 3)).limit(0), fact_path, month(9))
    assert stale() == [month(m) for m in (4, 5, 6, 9)]
    K.refresh_pairs(read_facts(spark, fact_path), pair_path, stale())
    check(spark, fact_path, pair_path)


def test_empty_table(spark, facts, tmp_path):
    fact = facts((1, "A", 2020, 1)).limit(0)
    K.build_pairs(fact, str(tmp_path / "p"))
    assert K.refresh_pairs(fact, str(tmp_path / "p"), [month(3)]) == []
    pairs = K.read_pairs(spark, str(tmp_path / "p"))
    assert pairs.count() == 0 and K.base_builder_kept(pairs).count() == 0 and K.stale_periods(fact, pairs).count() == 0


def test_monthly_load_refreshes_the_pairs(spark, facts, tmp_path):
    from periodica.plans import load_month
    from periodica.presets import BRAND_A

    fact_path, pair_path, text = str(tmp_path / "fato"), str(tmp_path / "pares"), tmp_path / "registro.txt"
    write_facts(facts((date(2026, 3, 1), "H-D/A", 2020, 10), (date(2026, 5, 1), "H-D/A", 2020, 30)), fact_path)
    K.build_pairs(read_facts(spark, fact_path), pair_path)
    text.write_bytes("UF;Município;Marca Modelo;Ano Fabricação;Qtd. Veículos\nSP;X;H-D/A;2020;14\n".encode("latin-1"))
    load_month(spark, str(text), fact_path, "2026-04-01", "2026-03-01", BRAND_A, pairs=pair_path)
    check(spark, fact_path, pair_path)
    assert [r[:3] for r in rows(registrations_of_pairs(K.read_pairs(spark, pair_path)))][-2:] == [
        (date(2026, 4, 1), 2020, 4.0),
        (date(2026, 5, 1), 2020, 16.0),
    ]
