"""Stock at a period: filter, group, sort, top-k, shares."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.functions.numbers import percent, round_binary
from periodica.functions.text import NO_INFORMATION, normalize_label, plain_text
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, date_lit, desc


def stock_by(
    fact: DataFrame, *keys: str, spec: SnapshotSpec = DEFAULT_SPEC, name: str = "total"
) -> DataFrame:
    """Units per key. Combined map-side, so a hot key costs one row per task in the shuffle."""
    return fact.groupBy(*keys).agg(F.sum(spec.measure).alias(name))


def at_period(fact: DataFrame, period: str | date, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    return fact.filter(F.col(spec.period) == date_lit(period))


def _top(frame: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    ordered = frame.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


# -- rankings -----------------------------------------------------------------------------------


def current_models(
    fact: DataFrame,
    period: str | date,
    spec: SnapshotSpec = DEFAULT_SPEC,
    limit: int | None = None,
) -> DataFrame:
    """Models at a period, largest first."""
    stock = stock_by(at_period(fact, period, spec), spec.model, spec=spec)
    return _top(stock, desc("total") + asc(spec.model), limit)


def top_models(
    fact: DataFrame, period: str | date, limit: int = 30, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    return current_models(fact, period, spec, limit)


def top_model(fact: DataFrame, period: str | date, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    return current_models(fact, period, spec, 1)


def model_year_distribution(
    fact: DataFrame,
    period: str | date,
    spec: SnapshotSpec = DEFAULT_SPEC,
    limit: int | None = None,
) -> DataFrame:
    """Known model years at a period, largest first; ties go to the newest."""
    known = at_period(fact, period, spec).filter(F.col(spec.year).isNotNull())
    return _top(stock_by(known, spec.year, spec=spec), desc("total", spec.year), limit)


def top_model_year(fact: DataFrame, period: str | date, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    return model_year_distribution(fact, period, spec, 1)


def top_cities(
    fact: DataFrame, period: str | date, limit: int = 20, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    stock = stock_by(at_period(fact, period, spec), spec.city, spec.state, spec=spec)
    return _top(stock, desc("total") + asc(spec.city, spec.state), limit)


def models_by_year(
    fact: DataFrame,
    year: int,
    period: str | date | None = None,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Models of one model year, at a period or over all of them."""
    rows = at_period(fact, period, spec) if period else fact
    stock = stock_by(rows.filter(F.col(spec.year) == year), spec.model, spec=spec)
    return _top(stock, desc("total") + asc(spec.model), None)


def fleet_model(
    fact: DataFrame,
    model: str,
    period: str | date | None = None,
    spec: SnapshotSpec = DEFAULT_SPEC,
    ordered: bool = True,
) -> DataFrame:
    """The rows of one model; ``ordered=False`` leaves out the total order, a shuffle of them."""
    rows = at_period(fact, period, spec) if period else fact
    kept = rows.filter(F.col(spec.model) == model).select(*spec.row_columns)
    order = [spec.period, spec.state, spec.city, spec.year, spec.measure]
    return kept.orderBy(*asc(*order)) if ordered else kept


def model_by_state(
    fact: DataFrame, model: str, period: str | date, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    rows = at_period(fact, period, spec).filter(F.col(spec.model) == model)
    return _top(stock_by(rows, spec.state, spec=spec), desc("total") + asc(spec.state), None)


def model_by_city(
    fact: DataFrame,
    model: str,
    period: str | date,
    limit: int = 15,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    rows = at_period(fact, period, spec).filter(F.col(spec.model) == model)
    stock = stock_by(rows, spec.city, spec.state, spec=spec)
    return _top(stock, desc("total") + asc(spec.city, spec.state), limit)


# -- shares -------------------------------------------------------------------------------------


def share_by_state(fact: DataFrame, period: str | date, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """State totals and their percentage of the country.

    The country total is a scalar subquery over the state totals: no join, and its shuffle is
    the one the main query reads.
    """
    states = stock_by(at_period(fact, period, spec), spec.state, spec=spec, name="total_uf")
    country = states.agg(F.sum("total_uf")).scalar()
    share = round_binary(percent(F.col("total_uf"), country))
    return states.withColumn("share_percentual", share).orderBy(*desc("total_uf"), *asc(spec.state))


def city_concentration(
    fact: DataFrame, period: str | date, limit: int = 20, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Largest cities with their percentage of the state and of the country.

    The cut to ``limit`` rows comes first, so shares are computed for the survivors only. The optimizer knows
    that bound and broadcasts the survivors if they are few.
    """
    cities = stock_by(at_period(fact, period, spec), spec.city, spec.state, spec=spec)
    states = _state_totals(cities, spec)
    country = cities.agg(F.sum("total")).scalar()
    leaders = _top(cities, desc("total") + asc(spec.city, spec.state), limit)

    same_state = F.col(f"s.{spec.state}").eqNullSafe(F.col(f"c.{spec.state}"))
    joined = states.alias("s").join(leaders.alias("c"), same_state)
    # A city without a state has no state total to be compared with.
    total_state = F.when(F.col(f"c.{spec.state}").isNotNull(), F.col("s.total_uf"))
    return joined.select(
        F.col(f"c.{spec.city}"),
        F.col(f"c.{spec.state}"),
        F.col("c.total"),
        total_state.alias("total_uf"),
        round_binary(percent(F.col("c.total"), total_state)).alias("share_uf_pct"),
        round_binary(percent(F.col("c.total"), country)).alias("share_brasil_pct"),
    ).orderBy(*desc("total"), *asc(spec.city, spec.state))


def _state_totals(cities: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    return cities.groupBy(spec.state).agg(F.sum("total").alias("total_uf"))


def gold_year(
    fact: DataFrame, period: str | date, limit: int = 20, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Largest model years with their percentage of the stock whose model year is known."""
    known = at_period(fact, period, spec).filter(F.col(spec.year).isNotNull())
    years = stock_by(known, spec.year, spec=spec)
    whole = years.agg(F.sum("total")).scalar()
    share = F.coalesce(percent(F.col("total"), whole), F.lit(0.0))
    return _top(years.withColumn("share_pct", share), desc("total", spec.year), limit)


def large_cities(
    fact: DataFrame, period: str | date, candidates: int = 30, limit: int = 15, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """The largest cities with both shares, the no-information bucket dropped after the cut to ``candidates``."""
    kept = _without_bucket(city_concentration(fact, period, candidates, spec), spec)
    return _top(kept, desc("total") + asc(spec.city, spec.state), limit)


def _without_bucket(cities: DataFrame, spec: SnapshotSpec) -> DataFrame:
    bucket = plain_text(NO_INFORMATION)
    return cities.filter(~normalize_label(F.col(spec.city)).eqNullSafe(F.lit(bucket)))


def concentration_leaders(
    fact: DataFrame,
    period: str | date,
    candidates: int = 30,
    minimum: int = 100,
    limit: int = 15,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Cities that weigh most in their own state, among the ``candidates`` largest cities.

    The no-information bucket is dropped after the cut, as is a city below ``minimum`` units.
    """
    cities = _without_bucket(city_concentration(fact, period, candidates, spec), spec)
    kept = cities.filter(F.col("total") >= minimum)
    return _top(kept, desc("share_uf_pct", "total") + asc(spec.city, spec.state), limit)
