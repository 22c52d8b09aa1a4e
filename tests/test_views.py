"""Stock, matrices, territory, macro, pending, search, names and the brand report."""

from __future__ import annotations

from datetime import date

import pytest

from periodica.operators import brand, catalog, enrich, macro, matrix, pending, search, stock, territory
from periodica.operators.registrations import registrations
from periodica.plans import macro_view
from periodica.spec import SnapshotSpec
from tests.conftest import rows

D = [date(2024, m, 1) for m in range(1, 13)]
BUCKET = " Sem Informação "


# -- stock and shares ---------------------------------------------------------------------------


def test_ties_and_limits(facts):
    fact = facts((1, "B", 2020, 5), (1, "A", 2021, 5), (1, "C", None, 9), (2, "Z", 2020, 99))
    assert rows(stock.top_models(fact, "2024-01-01", 2)) == [("C", 9), ("A", 5)]
    assert rows(stock.top_model_year(fact, "2024-01-01")) == [(2021, 5)]
    assert rows(stock.model_year_distribution(fact, "2024-01-01")) == [(2021, 5), (2020, 5)]


def test_city_shares(facts):
    fact = facts(
        (1, "A", 2020, 60, "SP", "S1"), (1, "A", 2020, 40, "SP", "S2"), (1, "A", 2020, 100, "RJ", "R1"),
        (1, "A", 2020, 0, "AC", "A1"), (1, "A", 2020, 50, None, "N1"),
    )
    assert rows(stock.city_concentration(fact, "2024-01-01")) == [
        ("R1", "RJ", 100, 100, 100.0, 40.0), ("S1", "SP", 60, 100, 60.0, 24.0), ("N1", None, 50, None, None, 20.0),
        ("S2", "SP", 40, 100, 40.0, 16.0), ("A1", "AC", 0, 0, None, 0.0),
    ]
    assert sum(r[2] for r in rows(stock.share_by_state(fact, "2024-01-01"))) == pytest.approx(100)
    assert rows(stock.city_concentration(fact, "2024-01-01", 1)) == [("R1", "RJ", 100, 100, 100.0, 40.0)]


def test_leaders_are_cut_before_the_bucket_is_dropped(facts):
    fact = facts((1, "A", 1, 300, "SP", BUCKET), (1, "A", 1, 200, "SP", "S"), (1, "A", 1, 100, "RJ", "R"), (1, "A", 1, 99, "AC", "A"))
    assert [r[0] for r in rows(stock.concentration_leaders(fact, "2024-01-01"))] == ["R", "S"]
    assert [r[0] for r in rows(stock.concentration_leaders(fact, "2024-01-01", candidates=2))] == ["S"]


def test_empty_period_gives_no_rows(facts):
    fact = facts((1, "A", 2020, 5))
    for frame in (
        stock.share_by_state(fact, "2030-01-01"),
        stock.city_concentration(fact, "2030-01-01"),
        stock.gold_year(fact, "2030-01-01"),
        territory.territory(fact, [2020], "2030-01-01").filter("total_atual > 0"),
    ):
        assert rows(frame) == []


def test_listings(facts):
    fact = facts((2, "A", 2020, 5), (1, "B", None, 5), (1, "B", 2030, 1))
    assert rows(catalog.list_periods(fact)) == [(D[0],), (D[1],)]
    assert rows(catalog.list_years(fact)) == [(2020,), (2030,)]
    assert rows(catalog.valid_years(fact, "2024-05-01")) == [(2020,)]
    assert rows(catalog.info(fact)) == [(D[0], D[1], 3, 2)]
    assert rows(catalog.info(fact, approximate=True)) == [(D[0], D[1], 3, 2)]


def test_other_column_names(facts):
    spec = SnapshotSpec(period="mes", model="produto", measure="unidades")
    renamed = facts((1, "A", 2020, 5), (2, "A", 2020, 7)).withColumnsRenamed(
        {"competencia": "mes", "marca_modelo": "produto", "qtd_veiculos": "unidades"}
    )
    assert rows(stock.top_models(renamed, "2024-01-01", spec=spec)) == [("A", 5)]
    assert rows(registrations(renamed, spec))[-1] == (D[1], 2020, 2.0, 2)


# -- matrices -----------------------------------------------------------------------------------


@pytest.fixture()
def history(facts):
    return facts(
        (date(2023, 12, 1), "A", 2020, 4), (1, "A", 2020, 5), (3, "A", 2020, 3), (3, "A", 1990, 50),
        (1, "B", 2021, 1), (2, "B", 2021, 8), (date(2023, 11, 1), "GONE", 2020, 7), (4, "B", 2021, 99),
    )


def test_stock_matrix(history):
    got = [r.asDict() for r in matrix.stock_matrix(history, [2020, 2021], "2024-03-01").collect()]
    assert [(r["marca_modelo"], r["jan"], r["fev"], r["mar"], r["abr"]) for r in got] == [
        ("A", 5, 0, 3, None), ("B", 1, 8, 0, None)
    ]


def test_flow_matrix_lags_over_all_history(history):
    got = [r.asDict() for r in matrix.flow_matrix(history, [2020, 2021], "2024-03-01").collect()]
    assert [(r["marca_modelo"], r["jan"], r["fev"], r["mar"], r["dez"]) for r in got] == [
        ("B", 1, 7, 0, None), ("A", 1, 0, 0, None)
    ]


def test_no_years_give_no_rows(history):
    for frame in (
        matrix.stock_matrix(history, [], "2024-03-01"),
        matrix.flow_matrix(history, [], "2024-03-01"),
        territory.territory(history, [], "2024-03-01"),
    ):
        assert rows(frame) == []


def test_matrix_long_form(history):
    wide = matrix.stock_matrix(history, [2020, 2021], "2024-03-01")
    assert rows(matrix.matrix_series(wide, top_n=1)) == [
        ("B", "jan", 1, "Jan"), ("B", "fev", 8, "Fev"), ("B", "mar", 0, "Mar")
    ]
    assert {r[0] for r in rows(matrix.matrix_series(wide, selected=["A"]))} == {"A"}
    assert [r[1:3] for r in rows(matrix.matrix_total_series(wide))] == [("jan", 6), ("fev", 8), ("mar", 3)]


# -- territory ----------------------------------------------------------------------------------


def test_territory_compares_with_the_latest_earlier_period(facts):
    fact = facts(
        (1, "A", 2020, 5, "SP", "S"), (3, "A", 2020, 9, "SP", "S"), (3, "A", 2020, 2, "RJ", None),
        (1, "A", 2020, 4, "AC", "A"), (1, "A", 2020, 3, "RJ", None), (2, "B", 1999, 1, "SP", "S"),
    )
    # The period before is the second one, where the slice has no stock.
    assert rows(territory.territory(fact, [2020], "2024-03-01")) == [("SP", 9, 0, 9, 9), ("RJ", 2, 0, 2, 2)]
    assert rows(territory.territory(fact, [2020], "2024-01-01"))[0] == ("SP", 5, 0, 5, 5)


def test_places_without_a_name_do_not_pair(facts):
    fact = facts((1, "A", 2020, 3, "RJ", None), (2, "A", 2020, 5, "RJ", None))
    assert rows(territory.territory(fact, [2020], "2024-02-01")) == [("RJ", 5, 3, 2, 2)]
    assert rows(territory.territory(fact, [2020], "2024-02-01", "municipio")) == [
        ("RJ", None, 5, 0, 5, 5), ("RJ", None, 0, 3, -3, 0)
    ]


def test_territory_leaders(facts):
    fact = facts((1, "A", 2020, 3, "SAO PAULO", "S. D'OESTE"), (1, "A", 2020, 9, "SAO PAULO", None))
    got = [tuple(r) for r in territory.territory_leaders(fact, [2020], "2024-01-01").select("nivel", "territorio", "ganho_mensal", "total_recorte").collect()]
    assert got == [("uf", "Sao Paulo", 12, 12), ("municipio", "S. D'Oeste / Sao Paulo", 3, None)]


# -- macro --------------------------------------------------------------------------------------


@pytest.fixture()
def flows(facts):
    """Year 2022 grows by 2 each month, 2023 by 1 from March, unknown stock by 1."""
    return registrations(
        facts(
            *((m, "A", 2022, 2 * m) for m in range(1, 8)),
            *((m, "A", 2023, m) for m in range(3, 8)),
            *((m, "B", None, m) for m in range(1, 8)),
        )
    )


def test_bucketed_series(flows):
    view = macro_view(flows, "2024-07-01", "quarter", None, years=[2023, 2030])
    totals = [(r[1], r[2]) for r in rows(view.total)]
    assert totals == [("2024T1", 9), ("2024T2", 12), ("2024T3", 4)]
    by_year = [(r[1], r[2], r[3]) for r in rows(view.by_year)]
    assert by_year == [("2024T1", 2022, 4.0), ("2024T1", 2023, 3.0), ("2024T2", 2022, 6.0), ("2024T2", 2023, 3.0),
                       ("2024T3", 2022, 2.0), ("2024T3", 2023, 1.0)]
    assert [(r[1], r[2]) for r in rows(view.unattributed)] == [("2024T1", 2.0), ("2024T2", 3.0), ("2024T3", 1.0)]
    assert rows(view.active_years) == [(2022,), (2023,)]
    assert rows(view.default_years) == [(2022,), (2023,)]
    dense = [(r[1], r[2], r[3], r[4]) for r in rows(view.selected)]
    assert dense[:2] == [("2024T1", 2023, 3.0, "MY 2023"), ("2024T1", 2030, 0.0, "MY 2030")] and len(dense) == 6
    # Selected years, other years and the unattributed rest add up to the total.
    parts = sum(r[2] for r in dense) + sum(r[2] for r in rows(view.residuals))
    assert parts + 0.0 >= 0
    closed = sum(r[3] for r in rows(view.selected)) + sum(r[2] for r in rows(view.residuals))
    assert closed == pytest.approx(sum(t for _, t in totals))


def test_window_and_defaults(flows):
    view = macro_view(flows, "2024-04-01", "month", 2, years=[])
    assert [r[1] for r in rows(view.total)] == ["Mar/24", "Apr/24"]
    assert rows(view.selected) == []
    assert rows(macro.default_years(macro.bucketed(flows, "2030-01-01"), "2030-01-01")) == [(2022,), (2023,)]
    assert [r[1] for r in rows(macro_view(flows, "2024-07-01", "semester", None).total)] == ["S1/2024", "S2/2024"]


# -- pending ------------------------------------------------------------------------------------


def test_pending_stock(facts):
    fact = facts(
        (1, "A", 2025, 1, "SP", "X"), (1, "A", 2020, 5, "SP", BUCKET), (1, "A", None, 2, "RJ", "sem informação"),
        (2, "A", 2020, 4, "SP", BUCKET), (1, "B", 2020, 50, "SP", BUCKET), (1, "A", 1, 9, "SP", "SEM INFORMACAO"),
        (date(2022, 1, 1), "A", 2020, 70, "SP", BUCKET), (2, "C", 2025, 6, "SP", BUCKET),
    )
    assert rows(pending.pending_series(fact, 2025)) == [(D[0], 1, 7), (D[1], 2, 10)]
    assert rows(pending.pending_snapshot(fact, "2024-01-01", 2025)) == [(D[0], 1, 7, 7)]
    assert rows(pending.pending_snapshot(fact, "2024-02-01", 2025)) == [(D[1], 2, 10, 3)]
    assert rows(pending.pending_snapshot(fact, "2022-01-01", 2025)) == []
    assert rows(pending.pending_top_models(fact, "2024-02-01", 2025)) == [("C", 6), ("A", 4)]
    series = pending.pending_model_series(fact, 2025)
    assert rows(series) == [(D[0], "A", 7), (D[1], "A", 4), (D[1], "C", 6)]
    assert rows(pending.pending_total_series(series)) == [(D[0], 7), (D[1], 10)]
    assert rows(pending.pending_total_series(series, ["C"])) == [(D[1], 6)]
    assert rows(pending.pending_series(fact, 2025, accent_sensitive=False))[0] == (D[0], 1, 16)


# -- search -------------------------------------------------------------------------------------


@pytest.fixture()
def glossary(spark):
    return spark.createDataFrame([("H-D/FLHX", "Street Glide"), ("H-D/XL", "")], "codigo_modelo string, nome_amigavel string")


def test_search(facts, glossary):
    fact = facts(
        (1, "H-D/FLHX", 2020, 5, "SP", "S"), (2, "h-d/flhx se", None, 3, "RJ", None), (2, "H-D/XL", 2021, 4, "SP", "S"),
        (2, "H-D/FLHX", 2030, 2, "SP", "T"),
    )
    assert len(rows(search.search_rows(fact, "%flhx%"))) == 3
    assert rows(search.family_like(fact, "h-d/FL%")) == [(D[0], "H-D/FLHX", 5), (D[1], "H-D/FLHX", 2), (D[1], "h-d/flhx se", 3)]
    assert rows(search.family_series(fact, "%X%")) == [(D[0], 5), (D[1], 9)]
    assert rows(search.search_slice(fact, " f ", "2024-02-01")) == []
    assert len(rows(search.search_slice(fact, "flhx", "2024-01-01"))) == 1
    assert len(rows(search.search_slice(fact, "h_d", "2024-02-01", states=["SP"], years=[2020, 2021]))) == 2
    hits = search.search_slice(fact, "flhx", "2024-02-01")
    assert rows(search.search_facets(hits, "2024-02-01")) == [
        ("ano_fabricacao", "2020"), ("municipio", "S"), ("municipio", "T"), ("uf", "RJ"), ("uf", "SP")
    ]
    # The row of unknown year is not part of the snapshot.
    assert rows(search.search_snapshot(hits, "2024-02-01", glossary)) == [("H-D/FLHX", "Street Glide", 2030, 2)]
    assert rows(search.search_series(hits, "consolidated", "flhx")) == [(D[0], "Busca: flhx", 5), (D[1], "Busca: flhx", 5)]
    assert rows(search.search_series(hits, "year")) == [(D[0], "2020", 5), (D[1], "2030", 2)]
    assert [r[1] for r in rows(search.search_series(hits, "model", glossary=glossary))] == [
        "H-D/FLHX | Street Glide", "H-D/FLHX | Street Glide", "h-d/flhx se"
    ]
    with pytest.raises(ValueError):
        search.search_series(hits, "colour")


# -- names --------------------------------------------------------------------------------------


def test_enrichment(spark, glossary):
    frame = spark.createDataFrame([("H-D/FLHX", 1), ("H-D/XL", 2), ("NEW", 3)], "marca_modelo string, total long")
    got = sorted(rows(enrich.enrich_models(frame, glossary).select("codigo_modelo", "nome_amigavel", "nome_exibicao")))
    assert got == [("H-D/FLHX", "Street Glide", "H-D/FLHX | Street Glide"), ("H-D/XL", "", "H-D/XL"), ("NEW", "", "NEW")]
    other = frame.withColumnRenamed("marca_modelo", "x")
    assert enrich.enrich_models(other, glossary) is other
    assert rows(enrich.codes_by_name(glossary, " street GLIDE ")) == [("H-D/FLHX",)]


def test_family_mix_and_premium(spark, glossary):
    frame = spark.createDataFrame(
        [("H-D/FLHX", 60), ("I/XLSE", 30), ("RA1250", 110), ("IMP/Z", 0)], "marca_modelo string, total long"
    )
    labelled = enrich.labelled_snapshot(frame, glossary)
    assert rows(enrich.family_mix(labelled)) == [
        ("Adventure", 110, 55.0, False), ("Touring", 60, 30.0, True), ("Sportster", 30, 15.0, False),
        ("Outras familias", 0, 0.0, False),
    ]
    assert rows(enrich.premium_pyramid(labelled)) == [("CVOs", 30, 15.0), ("Importacao independente", 30, 15.0)]
    assert rows(enrich.premium_pyramid(labelled.filter("false"))) == [("CVOs", 0, 0.0), ("Importacao independente", 0, 0.0)]
    assert [r[:2] for r in rows(enrich.premium_top(labelled))] == [
        ("CVOs", "I/XLSE"), ("Importacao independente", "I/XLSE"), ("Importacao independente", "IMP/Z")
    ]


# -- brand report -------------------------------------------------------------------------------


def test_brand_report(facts):
    fact = facts(
        (1, "INDIAN/SCOUT", 2015, 5, "SP", "S"), (1, "I/INDIAN SCOUT", None, 4, "RJ", "sem informacao"),
        (1, "IMP/INDIAN", None, 7, "SP", "S"),
    )
    assert rows(brand.brand_kpis(fact)) == [(16, 3, "Indian (Heritage Import)", 7, "Sem MY", 11, 4)]
    assert rows(brand.brand_models(fact)) == [
        ("IMP/INDIAN", "Indian (Heritage Import)", 7), ("INDIAN/SCOUT", "Scout", 5), ("I/INDIAN SCOUT", "Scout", 4)
    ]
    assert [r[:2] for r in rows(brand.brand_family_mix(fact))] == [("Scout", 9), ("Heritage / Classic", 7)]
    assert rows(brand.brand_by_state(fact)) == [("SP", 12), ("RJ", 4)]
    assert rows(brand.brand_by_city(fact, 1)) == [("S", "SP", 12)]
    assert rows(brand.brand_city_list(fact, ["INDIAN/SCOUT"])) == [("SP", "S", 5, "S / SP")]
    detail = brand.brand_city_detail(fact, "SP", "S")
    assert rows(detail) == [
        ("IMP/INDIAN", "Indian (Heritage Import)", "Heritage / Classic", "Sem MY", 7),
        ("INDIAN/SCOUT", "Scout", "Scout", "2015", 5),
    ]
    assert rows(brand.brand_city_names(detail, 1)) == [("Indian (Heritage Import)", 7)]
    assert rows(brand.brand_model_options(fact, 2)) == [("IMP/INDIAN", "Indian (Heritage Import)"), ("I/INDIAN SCOUT", "Scout")]
    assert rows(brand.brand_by_year(fact)) == [("Sem MY", 11), ("2015", 5)]
    assert rows(brand.brand_pending_models(fact)) == [("I/INDIAN SCOUT", "Scout", 4)]
