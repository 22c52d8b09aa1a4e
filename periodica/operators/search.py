"""Free-text search over model codes, slices of the hits, and their series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.functions.frames import sort_bounded
from periodica.functions.text import like_ignore_case
from periodica.operators.enrich import enrich_models
from periodica.operators.stock import at_period, stock_by
from periodica.sources.dictionary import rows_with_codes
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, date_lit, desc, to_date

# Values of ``segment``, and the column each one groups by.
SEGMENTS = ("consolidated", "model", "year", "state", "city")


def _hits(fact: DataFrame, pattern: str, spec: SnapshotSpec, codes: DataFrame | None = None) -> DataFrame:
    """Matching rows; with the fact's ``codes`` (``sources.dictionary``) the pattern is compared with these, not with every row."""
    if codes is not None:
        return rows_with_codes(fact, codes, pattern, spec).select(*spec.row_columns)
    return fact.filter(like_ignore_case(F.col(spec.model), pattern)).select(*spec.row_columns)


def search_rows(
    fact: DataFrame,
    pattern: str,
    spec: SnapshotSpec = DEFAULT_SPEC,
    ordered: bool = True,
    codes: DataFrame | None = None,
) -> DataFrame:
    """Rows whose code matches a case-insensitive LIKE pattern.

    ``ordered=False`` leaves out the total order, a shuffle of all hits.
    """
    rows = _hits(fact, pattern, spec, codes)
    if not ordered:
        return rows
    order = [spec.period, spec.model, spec.state, spec.city, spec.year, spec.measure]
    return rows.orderBy(*asc(*order))


def family_like(
    fact: DataFrame, pattern: str, spec: SnapshotSpec = DEFAULT_SPEC, codes: DataFrame | None = None
) -> DataFrame:
    """Matching stock per (period, model)."""
    stock = stock_by(_hits(fact, pattern, spec, codes), spec.period, spec.model, spec=spec)
    return stock.orderBy(*asc(spec.period, spec.model))


def family_series(
    fact: DataFrame, pattern: str, spec: SnapshotSpec = DEFAULT_SPEC, codes: DataFrame | None = None
) -> DataFrame:
    """Matching stock per period."""
    return sort_bounded(stock_by(_hits(fact, pattern, spec, codes), spec.period, spec=spec), *asc(spec.period))


def search_slice(
    fact: DataFrame,
    term: str,
    period: str | date,
    years: Sequence[int] = (),
    states: Sequence[str] = (),
    cities: Sequence[str] = (),
    spec: SnapshotSpec = DEFAULT_SPEC,
    codes: DataFrame | None = None,
) -> DataFrame:
    """Rows whose code contains ``term``, up to the reference period, within the given lists.

    A term shorter than two characters finds nothing; LIKE wildcards in it act as wildcards.
    """
    term = term.strip()
    if len(term) < 2:
        return fact.select(*spec.row_columns).filter(F.lit(False))
    rows = _hits(fact, f"%{term}%", spec, codes).filter(F.col(spec.period) <= date_lit(period))
    for column, values in ((spec.year, years), (spec.state, states), (spec.city, cities)):
        if values:
            rows = rows.filter(F.col(column).isin(list(values)))
    return rows


def search_facets(
    hits: DataFrame, period: str | date, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Distinct model years (up to the reference year), states and cities of the hits.

    The three lists come from one pass: each row offers its three values, and duplicates are
    removed map-side before the only shuffle.
    """
    year = F.col(spec.year)
    allowed = F.when(year <= to_date(period).year, year)
    choices = {spec.year: allowed.cast("string"), spec.state: F.col(spec.state), spec.city: F.col(spec.city)}
    offers = F.array(
        *(F.struct(F.lit(facet).alias("faceta"), value.alias("valor")) for facet, value in choices.items())
    )
    values = hits.select(F.inline(offers)).filter(F.col("valor").isNotNull())
    return values.distinct().orderBy(*asc("faceta", "valor"))


def search_snapshot(
    hits: DataFrame,
    period: str | date,
    glossary: DataFrame | None = None,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """The slice at the reference period by code and known model year, with friendly names."""
    known = at_period(hits, period, spec).filter(F.col(spec.year).isNotNull())
    stock = stock_by(known, spec.model, spec.year, spec=spec, name=spec.measure)
    named = enrich_models(stock, glossary, spec.model)
    columns = ["codigo_modelo", "nome_amigavel", spec.year, spec.measure]
    return named.select(*columns).orderBy(*desc(spec.measure), *asc("codigo_modelo", spec.year))


def search_series(
    hits: DataFrame,
    segment: str = "consolidated",
    term: str = "",
    glossary: DataFrame | None = None,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Units per period and segment value; rows without a value are dropped."""
    if segment not in SEGMENTS:
        raise ValueError(f"unknown segment {segment!r}, expected one of {SEGMENTS}")
    if segment == "consolidated":
        series = stock_by(hits, spec.period, spec=spec, name="valor").withColumn(
            "serie", F.lit(f"Busca: {term.strip()}")
        )
    elif segment == "model":
        # Summed per code before names are attached, then per name.
        stock = stock_by(hits, spec.period, spec.model, spec=spec, name="valor")
        named = enrich_models(stock, glossary, spec.model).withColumn("serie", F.col("nome_exibicao"))
        series = named.groupBy(spec.period, "serie").agg(F.sum("valor").alias("valor"))
    else:
        column = {"year": spec.year, "state": spec.state, "city": spec.city}[segment]
        present = hits.filter(F.col(column).isNotNull())
        series = stock_by(present, spec.period, column, spec=spec, name="valor").withColumn(
            "serie", F.col(column).cast("string")
        )
    return series.select(spec.period, "serie", "valor").orderBy(*asc(spec.period, "serie"))


def search_series_by_segment(
    hits: DataFrame, term: str = "", glossary: DataFrame | None = None, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """``search_series`` of every segment, told apart by ``segmento``.

    One pass over the hits: each row offers its value for every segment, and sums are combined map-side
    before the only shuffle of their size. Names are attached to the summed codes.
    """
    values = {
        "consolidated": F.lit(f"Busca: {term.strip()}"),
        "model": F.col(spec.model),
        "year": F.col(spec.year).cast("string"),
        "state": F.col(spec.state),
        "city": F.col(spec.city),
    }
    offers = F.array(*(F.struct(F.lit(s).alias("segmento"), values[s].alias("serie")) for s in SEGMENTS))
    # A code may be missing, a missing value of the other segments has no series.
    kept = F.col("serie").isNotNull() | (F.col("segmento") == "model")
    offered = hits.select(spec.period, F.col(spec.measure).alias("valor"), F.inline(offers)).filter(kept)
    sums = offered.groupBy(spec.period, "segmento", "serie").agg(F.sum("valor").alias("valor"))
    of_model = F.when(F.col("segmento") == "model", F.col("serie"))
    named = enrich_models(sums.withColumn("_modelo", of_model), glossary, "_modelo")
    serie = F.when(F.col("segmento") == "model", F.col("nome_exibicao")).otherwise(F.col("serie"))
    series = named.select(spec.period, "segmento", serie.alias("serie"), "valor")
    summed = series.groupBy(spec.period, "segmento", "serie").agg(F.sum("valor").alias("valor"))
    return summed.orderBy(*asc("segmento", spec.period, "serie"))
