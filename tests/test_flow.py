"""One test per delta convention, on frames small enough to compute by hand."""

from __future__ import annotations

from datetime import date

import pytest

from periodica.operators import flow
from periodica.operators.pairs import period_pairs
from periodica.operators.registrations import adjusted_flow, registrations
from tests.conftest import rows

D = [date(2024, m, 1) for m in range(1, 13)]


@pytest.fixture()
def gap(facts):
    """A is absent in the second of four periods; B is constant."""
    return facts(
        (1, "A", 2020, 5), (3, "A", 2020, 3), (4, "A", 2020, 9),
        (1, "B", 2020, 1), (2, "B", 2020, 1), (3, "B", 2020, 1), (4, "B", 2020, 1),
    )


def test_pairs_compare_with_the_previous_observed_period(gap):
    pairs = period_pairs(gap, ["marca_modelo"])
    a = {r[0]: r[3:] for r in rows(pairs) if r[2] == "A"}
    assert a == {D[0]: (5, 0), D[1]: (0, 5), D[2]: (3, 0), D[3]: (9, 3)}


def test_pairs_keep_the_phantom_row_of_the_first_period(gap):
    nulls = [r for r in rows(period_pairs(gap, ["marca_modelo"])) if r[2] is None]
    assert nulls == [(D[0], None, None, 0, 0)]


def test_pairs_never_match_null_keys(facts):
    fact = facts((1, None, 2020, 5), (2, None, 2020, 6))
    got = sorted(r[3:] for r in rows(period_pairs(fact, ["marca_modelo"])))
    assert got == [(0, 0), (0, 5), (5, 0), (6, 0)]
    # The whole stock of the second period counts as flow.
    assert rows(flow.annual_flow(fact)) == [(2024, 2, 6)]


def test_annual_flow_ignores_the_first_period(gap):
    assert rows(flow.annual_flow(gap)) == [(2024, 4, 9)]


def test_base_builder_ranks_models_and_ends_with_the_phantom(gap):
    assert rows(flow.base_builder_ranking(gap)) == [("A", 9), ("B", 0), (None, 0)]


def test_ranking_and_annual_totals_agree(gap):
    ranked = sum(r[1] for r in rows(flow.base_builder_ranking(gap)))
    assert ranked == sum(r[2] for r in rows(flow.annual_flow(gap)))


def test_entries_fill_the_calendar_with_zero(gap):
    assert rows(flow.entries_proxy(gap, "A")) == [
        (D[0], 5, 0, 0), (D[1], 0, -5, 0), (D[2], 3, 3, 3), (D[3], 9, 6, 6)
    ]


def test_entries_cut_after_the_lag(gap):
    assert rows(flow.entries_proxy(gap, "A", "2024-03-01", "2024-03-01")) == [(D[2], 3, 3, 3)]


def test_snapshot_lags_over_present_periods_only(gap):
    assert rows(flow.model_snapshot(gap, "A", "2024-01-01")) == [(D[0], 5, 5)]
    assert rows(flow.model_snapshot(gap, "A", "2024-02-01")) == []
    assert rows(flow.model_snapshot(gap, "A", "2024-03-01")) == [(D[2], 3, -2)]


def test_variation_is_null_when_a_period_is_missing(gap):
    assert rows(flow.model_variation(gap, "A", "2024-01-01", "2024-04-01")) == [(5, 9, 4)]
    assert rows(flow.model_variation(gap, "A", "2024-02-01", "2024-04-01")) == [(None, 9, None)]


def test_percent_change_needs_a_base(facts):
    fact = facts((1, "A", 2020, 0), (2, "A", 2020, 5), (3, "A", 2020, 6))
    assert rows(flow.national_snapshot(fact, "2024-01-01")) == [(D[0], 0, None)]
    assert rows(flow.national_snapshot(fact, "2024-02-01")) == [(D[1], 5, None)]
    assert rows(flow.national_snapshot(fact, "2024-03-01")) == [(D[2], 6, 20.0)]


def test_series_lists_present_periods(gap):
    assert rows(flow.model_series(gap, "A")) == [(D[0], 5), (D[2], 3), (D[3], 9)]


# -- registrations ------------------------------------------------------------------------------


def test_late_identification_is_not_a_registration(facts):
    """Unknown stock falls 10 to 6 while year 2000 grows 0 to 7: only 3 are new."""
    fact = facts((1, "A", None, 10), (2, "A", None, 6), (2, "A", 2000, 7))
    got = rows(registrations(fact))
    # Without known-year stock before it, the second period keeps a NULL row as well.
    assert got == [(D[0], None, 0.0, 0), (D[1], 2000, 3.0, 3), (D[1], None, 0.0, 3)]


def test_correction_is_shared_in_proportion(facts):
    fact = facts(
        (1, "A", None, 8), (1, "A", 2001, 1), (1, "A", 2002, 1),
        (2, "A", None, 4), (2, "A", 2001, 7), (2, "A", 2002, 3),
    )
    assert rows(registrations(fact)) == [
        (D[0], 2001, 0.0, 0), (D[0], 2002, 0.0, 0), (D[0], None, 0.0, 0),
        (D[1], 2001, 3.0, 4), (D[1], 2002, 1.0, 4),
    ]


def test_unknown_stock_that_vanishes_counts_whole(facts):
    fact = facts((1, "A", None, 5), (1, "A", 2001, 1), (2, "A", 2001, 4))
    assert [r for r in rows(registrations(fact)) if r[0] == D[1]] == [(D[1], 2001, 0.0, 0)]


def test_models_without_code_get_no_corrected_flow(facts):
    fact = facts((1, "A", 2001, 1), (1, None, 2001, 1), (2, "A", 2001, 1), (2, None, 2001, 4))
    assert [r for r in rows(registrations(fact)) if r[0] == D[1]] == [(D[1], 2001, 0.0, 4)]


def test_registration_identities(facts):
    fact = facts(
        *((m, model, year, (m * 7 + len(model) * 5 + (year or 3)) % 11 + 1)
          for m in range(1, 7) for model in ("A", "BB", "CCC") for year in (None, 2001, 2002)
          if (m + len(model) + (year or 0)) % 4)
    )
    groups: dict = {}
    for r in adjusted_flow(fact).collect():
        assert 0 <= r["emplacamentos"] <= r["bruto"]
        groups.setdefault((r["competencia"], r["marca_modelo"]), []).append(r)
    stock = {(r[0], r[3], r[4]): r[5] for r in rows(fact)}
    for (period, model), cells in groups.items():
        index = D.index(period)
        before = D[index - 1] if index else None
        drop = max(stock.get((before, model, None), 0) - stock.get((period, model, None), 0), 0)
        grown = sum(c["bruto"] for c in cells)
        assert sum(c["emplacamentos"] for c in cells) == pytest.approx(max(grown - drop, 0))


def test_every_period_appears(facts):
    fact = facts((1, "A", None, 5), (2, "A", None, 7), (3, "A", None, 7))
    assert rows(registrations(fact)) == [(D[0], None, 0.0, 0), (D[1], None, 0.0, 2), (D[2], None, 0.0, 0)]


def history(facts):
    """Gaps, a model that vanishes, one that comes back, unknown years, NULL places."""
    return facts(
        (1, "A", 2020, 5), (1, "B", 2020, 3), (1, "A", None, 4),
        (2, "A", 2020, 7), (2, "A", None, 2), (2, "C", 2021, 1, None, None),
        (5, "A", 2020, 9), (5, "B", 2020, 4), (5, "D", None, 8, "SP", None),
        (6, "A", 2020, 9), (6, "C", 2021, 6), (6, "D", 2022, 8),
        (9, "A", 2021, 2), (9, "B", 2020, 9),
    )


@pytest.mark.parametrize("since", [None, 1, 2, 3, 5, 6, 7, 9, 12])
@pytest.mark.parametrize("until", [None, 1, 5, 7, 9])
def test_bounded_history_gives_the_same_rows(spark, facts, since, until):
    fact = history(facts)
    low = None if since is None else date(2024, since, 1)
    high = None if until is None else date(2024, until, 1)

    def kept(row):
        return (low is None or row[0] >= low) and (high is None or row[0] <= high)

    bounded = rows(registrations(fact, since=low, until=high))
    assert bounded == [r for r in rows(registrations(fact)) if kept(r)]
    for model in ("A", "B"):
        every = rows(flow.entries_proxy(fact, model))
        assert rows(flow.entries_proxy(fact, model, low, high)) == [r for r in every if kept(r)]


def test_trailing_months_are_bounded(spark, facts):
    from periodica.functions.dates import first_trailing_month
    from periodica.operators import macro

    fact = history(facts)
    for months in (None, 1, 2, 4, 12):
        want = rows(macro.trailing_window(registrations(fact), "2024-06-01", months))
        assert rows(macro.trailing_window(macro.trailing_registrations(fact, "2024-06-01", months), "2024-06-01", months)) == want
    assert first_trailing_month("2024-03-31", 2) == date(2024, 2, 29)
    assert first_trailing_month("2024-01-01", 12) == date(2023, 2, 1)
    assert first_trailing_month("2024-01-15", 1) == date(2024, 1, 15)
