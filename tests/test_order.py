"""The order in which results come, which the comparison with SQL leaves out: ``-`` is descending, nulls are last."""

from __future__ import annotations

import os

import pytest

from workload.queries import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

ORDERS = {
    "list_periods": "competencia",
    "list_years": "ano_fabricacao",
    "top_models": "-total marca_modelo",
    "current_models": "-total marca_modelo",
    "top_cities": "-total municipio",
    "share_by_uf": "-total_uf uf",
    "city_concentration": "-total municipio uf",
    "annual_flow": "ano",
    "annual_flow_kept": "ano",
    "base_builder_ranking": "-vendas_proxy_total marca_modelo",
    "base_builder_kept": "-vendas_proxy_total marca_modelo",
    "model_series": "competencia",
    "entries_proxy": "competencia",
    "registrations_macro": "competencia ano_fabricacao",
    "registrations_kept": "competencia ano_fabricacao",
    "trailing_window": "competencia ano_fabricacao",
    "registrations_by_bucket_year": "period_start ano_fabricacao",
    "registrations_total_by_bucket": "period_start",
    "registrations_unattributed": "period_start",
    "active_years": "ano_fabricacao",
    "default_years": "ano_fabricacao",
    "selected_years_dense": "period_start ano_fabricacao",
    "other_years_residual": "period_start serie",
    "pending_series": "competencia",
    "pending_model_series": "competencia marca_modelo",
    "pending_total_series": "competencia",
    "stock_matrix": "-jul marca_modelo",
    "territory_uf": "-ganho_mensal -total_atual uf",
    "territory_city": "-ganho_mensal -total_atual",
    "territory_leaders": "-nivel -ganho_mensal -total_atual territorio",
    "search_rows": "competencia marca_modelo uf municipio ano_fabricacao qtd_veiculos",
    "search_rows_by_codes": "competencia marca_modelo uf municipio ano_fabricacao qtd_veiculos",
    "family_like": "competencia marca_modelo",
    "family_like_by_codes": "competencia marca_modelo",
    "family_series": "competencia",
    "search_facets": "faceta valor",
    "search_snapshot": "-qtd_veiculos codigo_modelo ano_fabricacao",
    "search_series_by_segment": "segmento competencia serie",
    "codes_by_name": "codigo_modelo",
    "family_mix": "-total family",
    "premium_top": "categoria -total codigo_modelo",
    "premium_pyramid": "categoria",
    "brand_by_uf": "-qtd_veiculos uf",
    "brand_by_city": "-qtd_veiculos municipio uf",
    "brand_model_options": "friendly_name marca_modelo",
    "brand_models": "-qtd_veiculos",
    "ingest_many_report": "competencia",
}


def follows(a, b, order: list[str]) -> bool:
    for key in order:
        left, right = a[key.lstrip("-")], b[key.lstrip("-")]
        if left == right:
            continue
        if left is None or right is None:
            return right is None
        return (left > right) == key.startswith("-")
    return True


@pytest.mark.parametrize("key", ORDERS)
def test_rows_come_in_order(spark, key):
    rows = QUERIES[key](spark, SF_DIR).collect()
    order = ORDERS[key].split()
    assert rows and all(follows(a, b, order) for a, b in zip(rows, rows[1:], strict=False))
