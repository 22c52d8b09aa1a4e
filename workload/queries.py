"""Keyed queries: one callable (session, folder) -> DataFrame per operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.functions.dates import bucket_label, bucket_start, month_label
from periodica.functions.text import normalize_label, normalize_text
from periodica.operators import (
    brand,
    catalog,
    enrich,
    flow,
    ingest,
    macro,
    matrix,
    pending,
    search,
    sketches,
    stock,
    territory,
)
from periodica.operators.registrations import FLOW, registrations, registrations_of_pairs
from periodica.plans.kept_pairs import annual_flow_kept, base_builder_kept
from periodica.presets import BRAND_A, BRAND_B
from periodica.sources.registry import canonicalize
from workload import params as p
from workload.views import (
    brand_b,
    codes,
    fleet,
    glossary,
    glossary_file,
    kept_pairs,
    load_report,
    loaded_period,
    many_months,
    raw_registry,
    registry_files,
)

Query = Callable[[SparkSession, str], DataFrame]

# -- helpers ------------------------------------------------------------------------------------


def six_digits(x: Column) -> Column:
    """Sums of doubles depend on their order in the last digits; both engines cut them here."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def _on_fleet(operator: Callable[..., DataFrame], *args: object, **kwargs: object) -> Query:
    return lambda spark, sf: operator(fleet(spark, sf), *args, **kwargs)


def _on_brand(operator: Callable[..., DataFrame], *args: object, **kwargs: object) -> Query:
    return lambda spark, sf: operator(brand_b(spark, sf), *args, **kwargs)


def _distinct(frame: DataFrame, column: str) -> DataFrame:
    return frame.select(column).distinct()


# -- ingest -------------------------------------------------------------------------------------


def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    return canonicalize(raw_registry(spark, sf))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.filter_brand(_canonical(spark, sf), BRAND_A.filter)
    return ingest.typed_rows(rows, BRAND_A, p.LOAD_PERIOD, source=p.SOURCE_FILE)


def _consolidated(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.consolidate(_typed(spark, sf))


def _text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = _canonical(spark, sf)
    texts = rows.select(F.explode(F.array("marca_modelo", "municipio")).alias("texto"))
    return texts.distinct().withColumn("normalizado", normalize_text(F.col("texto")))


def _brand_rows(brand_filter) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = ingest.filter_brand(_canonical(spark, sf), brand_filter)
        return rows.groupBy("marca_modelo").agg(F.count(F.lit(1)).alias("linhas"))

    return query


def _code_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.filter_brand(_canonical(spark, sf), BRAND_A.filter).groupBy("marca_modelo").count()
    code = ingest.canonical_code(F.col("marca_modelo"), BRAND_A.aliases)
    return rows.groupBy(code.alias("codigo")).agg(F.sum("count").alias("linhas"))


def _two_headers(spark: SparkSession, sf: str) -> DataFrame:
    accepted = registry_files(spark, sf).accepted.drop("filename")
    rows = ingest.filter_brand(accepted, BRAND_A.filter)
    return ingest.consolidate(ingest.typed_rows(rows, BRAND_A, p.LOAD_PERIOD, source=p.SOURCE_FILE))


def _rejected(spark: SparkSession, sf: str) -> DataFrame:
    return registry_files(spark, sf).rejected().groupBy("registro", "motivo").agg(F.count(F.lit(1)).alias("linhas"))


# -- registrations and their buckets ------------------------------------------------------------


def _registrations(spark: SparkSession, sf: str) -> DataFrame:
    return registrations(fleet(spark, sf))


def _trailing(spark: SparkSession, sf: str, months: int | None) -> DataFrame:
    return macro.trailing_registrations(fleet(spark, sf), p.REF, months)


def _rounded(frame: DataFrame, column: str = FLOW) -> DataFrame:
    return frame.withColumn(column, six_digits(F.col(column)))


def _on_buckets(operator: Callable[..., DataFrame], grain: str, *args: object) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = macro.bucketed(_trailing(spark, sf, p.MONTHS_BACK), p.REF, grain, p.MONTHS_BACK)
        frame = operator(rows, *args)
        return _rounded(frame) if FLOW in frame.columns else frame

    return query


def _sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct models of each calendar year, exact, and whether the united sketches of its periods tell them as well as stated."""
    year = F.year("competencia").alias("ano")
    exact = fleet(spark, sf).groupBy(year).agg(F.countDistinct("marca_modelo").alias("modelos_distintos"))
    found = sketches.distinct_models(sketches.period_sketches(fleet(spark, sf)), year).join(exact, "ano")
    near = sketches.within_bound(F.col(sketches.MODELS), F.col("modelos_distintos")).alias("no_limite")
    return found.select("ano", "periodos", "linhas", "total", "modelos_distintos", near)


def _period_bucket(spark: SparkSession, sf: str) -> DataFrame:
    periods = catalog.list_periods(fleet(spark, sf))
    columns = {}
    for grain in ("month", "quarter", "semester"):
        columns[f"{grain}_start"] = bucket_start(F.col("competencia"), grain)
        columns[f"{grain}_label"] = bucket_label(F.col("competencia"), grain)
    return periods.withColumns(columns)


# -- other compositions -------------------------------------------------------------------------


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return stock.current_models(fleet(spark, sf), p.REF)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.labelled_snapshot(_snapshot(spark, sf), glossary(spark, sf))


def _slice(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_slice(fleet(spark, sf), p.TERM, p.REF, years=p.YEARS)


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_slice(fleet(spark, sf), p.TERM, p.REF)


def _series_of_all_segments(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_series_by_segment(_hits(spark, sf), p.TERM, glossary(spark, sf))


def _classify(spark: SparkSession, sf: str) -> DataFrame:
    codes = enrich.enrich_models(_distinct(fleet(spark, sf), "marca_modelo"), glossary(spark, sf))
    return enrich.with_family(codes).select("codigo_modelo", "nome_amigavel", "family")


def _brand_codes(column: str, expression: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _distinct(brand_b(spark, sf), "marca_modelo").withColumn(column, expression(F.col("marca_modelo")))

    return query


def queries() -> dict[str, Query]:
    return {
        # sources and cleansing
        "ingest_canonical_columns": _canonical,
        "text_normalize": _text_normalize,
        "brand_filter_contains": _brand_rows(BRAND_A.filter),
        "brand_filter_regex": _brand_rows(BRAND_B.filter),
        "code_canonicalize": _code_canonicalize,
        "ingest_typed_rows": _typed,
        "ingest_consolidate": _consolidated,
        "ingest_replace_period": lambda s, d: loaded_period(s, d, p.LOAD_PERIOD, lambda: _consolidated(s, d)),
        "ingest_reconcile": load_report,
        "ingest_two_headers": _two_headers,
        "ingest_rejected": _rejected,
        "ingest_many_months": lambda s, d: many_months(s, d, "fato").filter(F.col("competencia").isin(*map(date.fromisoformat, p.LOAD_PERIODS))),
        "ingest_many_report": lambda s, d: many_months(s, d, "relatorio"),
        "glossary_load": glossary_file,
        # catalogue
        "list_periods": _on_fleet(catalog.list_periods),
        "list_years": _on_fleet(catalog.list_years),
        "info": _on_fleet(catalog.info),
        "distinct_models_sketched": _sketched,
        "valid_years": _on_fleet(catalog.valid_years, "1998-07-01"),
        # stock at a period
        "top_models": _on_fleet(stock.top_models, p.REF),
        "top_model_year": _on_fleet(stock.top_model_year, p.REF),
        "model_year_distribution": _on_fleet(stock.model_year_distribution, p.REF),
        "top_model": _on_fleet(stock.top_model, p.REF),
        "current_models": _on_fleet(stock.current_models, p.REF),
        "top_cities": _on_fleet(stock.top_cities, p.REF),
        "models_by_year": _on_fleet(stock.models_by_year, p.YEARS[0]),
        "models_by_year_at_period": _on_fleet(stock.models_by_year, p.YEARS[0], p.REF),
        "fleet_model_at_period": _on_fleet(stock.fleet_model, p.MODEL, p.REF),
        "fleet_model": _on_fleet(stock.fleet_model, p.MODEL),
        "model_by_uf": _on_fleet(stock.model_by_state, p.MODEL, p.REF),
        "model_by_city": _on_fleet(stock.model_by_city, p.MODEL, p.REF),
        # shares
        "share_by_uf": _on_fleet(stock.share_by_state, p.REF),
        "city_concentration": _on_fleet(stock.city_concentration, p.REF),
        "gold_year": _on_fleet(stock.gold_year, p.REF),
        "concentration_leaders": _on_fleet(stock.concentration_leaders, p.REF),
        "large_cities": _on_fleet(stock.large_cities, p.REF),
        # stock to flow
        "model_snapshot": _on_fleet(flow.model_snapshot, p.MODEL, p.REF),
        "entries_proxy": _on_fleet(flow.entries_proxy, p.MODEL, p.START, p.END),
        "annual_flow": _on_fleet(flow.annual_flow),
        "base_builder_ranking": _on_fleet(flow.base_builder_ranking),
        "registrations_macro": lambda s, d: _rounded(_registrations(s, d)),
        # the same from a table of pairs that monthly loads keep up to date
        "registrations_kept": lambda s, d: _rounded(registrations_of_pairs(kept_pairs(s, d, p.LATE_LOADS))),
        "annual_flow_kept": lambda s, d: annual_flow_kept(kept_pairs(s, d, p.LATE_LOADS)),
        "base_builder_kept": lambda s, d: base_builder_kept(kept_pairs(s, d, p.LATE_LOADS)),
        "model_variation": _on_fleet(flow.model_variation, p.MODEL, p.START, p.END),
        "national_snapshot": _on_fleet(flow.national_snapshot, p.REF),
        "model_series": _on_fleet(flow.model_series, p.MODEL),
        # buckets and residuals
        "trailing_window": lambda s, d: _rounded(macro.trailing_window(_trailing(s, d, 12), p.REF, 12)),
        "period_bucket": _period_bucket,
        "registrations_by_bucket_year": _on_buckets(macro.flow_by_bucket_and_year, "quarter"),
        "registrations_total_by_bucket": _on_buckets(macro.total_by_bucket, "semester"),
        "registrations_unattributed": _on_buckets(macro.unattributed_by_bucket, "quarter"),
        "active_years": _on_buckets(macro.active_years, "month"),
        "selected_years_dense": _on_buckets(macro.selected_years_dense, "quarter", p.YEARS),
        "other_years_residual": _on_buckets(macro.residual_series, "quarter", p.YEARS),
        "default_years": _on_buckets(macro.default_years, "month", p.REF),
        "default_years_fallback": _on_buckets(macro.default_years, "month", p.LATE),
        # pending stock
        "pending_series": _on_fleet(pending.pending_series, p.PENDING_YEAR),
        "pending_snapshot": _on_fleet(pending.pending_snapshot, p.REF, p.PENDING_YEAR),
        "pending_top_models": _on_fleet(pending.pending_top_models, p.REF, p.PENDING_YEAR),
        "pending_model_series": _on_fleet(pending.pending_model_series, p.PENDING_YEAR),
        "pending_total_series": lambda s, d: pending.pending_total_series(
            pending.pending_model_series(fleet(s, d), p.PENDING_YEAR)
        ),
        "pending_total_of_models": lambda s, d: pending.pending_total_series(
            pending.pending_model_series(fleet(s, d), p.PENDING_YEAR), p.SOME_MODELS
        ),
        # matrices
        "stock_matrix": _on_fleet(matrix.stock_matrix, p.YEARS, p.REF),
        "flow_matrix": _on_fleet(matrix.flow_matrix, p.YEARS, p.REF),
        "matrix_unpivot_topn": lambda s, d: matrix.matrix_series(
            matrix.stock_matrix(fleet(s, d), p.YEARS, p.REF)
        ),
        "matrix_named_rows": lambda s, d: matrix.matrix_series(
            matrix.stock_matrix(fleet(s, d), p.YEARS, p.REF), selected=p.SOME_MODELS
        ),
        "matrix_total_series": lambda s, d: matrix.matrix_total_series(
            matrix.flow_matrix(fleet(s, d), p.YEARS, p.REF)
        ),
        # territory
        "territory_uf": _on_fleet(territory.territory, p.YEARS, p.REF, "uf"),
        "territory_city": _on_fleet(territory.territory, p.YEARS, p.REF, "municipio"),
        "territory_leaders": _on_fleet(territory.territory_leaders, p.YEARS, p.REF),
        # search
        "search_rows": _on_fleet(search.search_rows, p.PATTERN),
        "family_like": _on_fleet(search.family_like, p.PATTERN),
        "family_series": _on_fleet(search.family_series, p.PATTERN),
        "search_slice": _slice,
        "search_slice_places": lambda s, d: search.search_slice(
            fleet(s, d), p.TERM, p.REF, states=p.SOME_STATES, cities=p.SOME_CITIES
        ),
        # the same through the dictionary of codes
        "search_rows_by_codes": lambda s, d: search.search_rows(fleet(s, d), p.PATTERN, codes=codes(s, d)),
        "family_like_by_codes": lambda s, d: search.family_like(fleet(s, d), p.PATTERN, codes=codes(s, d)),
        "search_slice_by_codes": lambda s, d: search.search_slice(fleet(s, d), p.TERM, p.REF, years=p.YEARS, codes=codes(s, d)),
        "search_facets": lambda s, d: search.search_facets(_hits(s, d), p.REF),
        "search_snapshot": lambda s, d: search.search_snapshot(_hits(s, d), p.REF, glossary(s, d)),
        "search_series_by_segment": _series_of_all_segments,
        # names, families, flags
        "enrich_models": lambda s, d: enrich.enrich_models(_snapshot(s, d), glossary(s, d)),
        "codes_by_name": lambda s, d: enrich.codes_by_name(glossary(s, d), " fat BOY "),
        "classify_family": _classify,
        "labelled_snapshot": _labelled,
        "normalize_label": lambda s, d: _distinct(fleet(s, d), "municipio").withColumn(
            "rotulo", normalize_label(F.col("municipio"))
        ),
        "month_label_pt": lambda s, d: catalog.list_periods(fleet(s, d)).withColumn(
            "rotulo", month_label(F.col("competencia"))
        ),
        "classify_family_b": _brand_codes(
            "family", lambda c: enrich.classify_by_text(c, BRAND_B.families, BRAND_B.default_family)
        ),
        "friendly_name_b": _brand_codes("friendly_name", lambda c: enrich.friendly_name(c, BRAND_B.names)),
        "family_mix": lambda s, d: enrich.family_mix(_labelled(s, d)),
        "premium_pyramid": lambda s, d: enrich.premium_pyramid(_labelled(s, d)),
        "premium_top": lambda s, d: enrich.premium_top(_labelled(s, d)),
        "base_builder_top": lambda s, d: enrich.base_builder_top(
            flow.base_builder_flow(fleet(s, d)), glossary(s, d)
        ),
        # one-period brand report
        "brand_kpis": _on_brand(brand.brand_kpis),
        "brand_models": _on_brand(brand.brand_models),
        "brand_family_mix": _on_brand(brand.brand_family_mix),
        "brand_by_uf": _on_brand(brand.brand_by_state),
        "brand_by_city": _on_brand(brand.brand_by_city),
        "brand_city_list": _on_brand(brand.brand_city_list, p.BRAND_MODELS),
        "brand_city_detail": _on_brand(brand.brand_city_detail, p.STATE, p.CITY),
        "brand_city_names": lambda s, d: brand.brand_city_names(brand.brand_city_detail(brand_b(s, d), p.STATE, p.CITY)),
        "brand_model_options": _on_brand(brand.brand_model_options),
        "brand_by_year": _on_brand(brand.brand_by_year),
        "brand_pending_models": _on_brand(brand.brand_pending_models),
    }
