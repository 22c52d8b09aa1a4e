"""Stock in the "no information" city bucket: units that wait for their registration."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.functions.frames import sort_bounded
from periodica.functions.text import is_no_information
from periodica.operators.stock import at_period, stock_by
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, date_lit, desc

UNITS = "total_sem_info"


def _pending_stock(
    fact: DataFrame, year: int, spec: SnapshotSpec, period: str | date | None, accent_sensitive: bool
) -> DataFrame:
    """Bucket stock per (period, model), in the year before the model year and in that year.

    Only models of the catalogue count: those with any row of the model year, at any period.
    Stock is summed before it meets the catalogue, so the semi join sees one row per period and
    model, and a model's weight in the raw table does not matter. Neither side has a known size
    bound; the optimizer broadcasts or shuffles by measured size.
    """
    window = F.col(spec.period).between(date_lit(date(year - 1, 1, 1)), date_lit(date(year, 12, 31)))
    rows = fact if period is None else at_period(fact, period, spec)
    bucket = rows.filter(window & is_no_information(F.col(spec.city), accent_sensitive))
    catalogue = fact.filter(F.col(spec.year) == year).select(spec.model).distinct()
    return stock_by(bucket, spec.period, spec.model, spec=spec, name=UNITS).join(
        catalogue, spec.model, "left_semi"
    )


def pending_model_series(
    fact: DataFrame, year: int, spec: SnapshotSpec = DEFAULT_SPEC, accent_sensitive: bool = True
) -> DataFrame:
    """Pending units per period and model."""
    stock = _pending_stock(fact, year, spec, None, accent_sensitive)
    return stock.select(spec.period, spec.model, UNITS).orderBy(*asc(spec.period, spec.model))


def pending_series(
    fact: DataFrame, year: int, spec: SnapshotSpec = DEFAULT_SPEC, accent_sensitive: bool = True
) -> DataFrame:
    """Distinct models and units per period."""
    stock = _pending_stock(fact, year, spec, None, accent_sensitive)
    # One row per (period, model): counting rows counts models.
    sums = stock.groupBy(spec.period).agg(F.count(spec.model).alias("modelos"), F.sum(UNITS).alias(UNITS))
    return sort_bounded(sums, *asc(spec.period))


def pending_snapshot(
    fact: DataFrame,
    period: str | date,
    year: int,
    spec: SnapshotSpec = DEFAULT_SPEC,
    accent_sensitive: bool = True,
) -> DataFrame:
    """One period of the series with its change since the previous present period.

    Outside the two years of the window there is no row.
    """
    series = pending_series(fact, year, spec, accent_sensitive)
    before = F.lag(UNITS).over(Window.orderBy(spec.period))
    lagged = series.withColumn("delta_sem_info", F.col(UNITS) - F.coalesce(before, F.lit(0)))
    return lagged.filter(F.col(spec.period) == date_lit(period))


def pending_top_models(
    fact: DataFrame,
    period: str | date,
    year: int,
    limit: int = 20,
    spec: SnapshotSpec = DEFAULT_SPEC,
    accent_sensitive: bool = True,
) -> DataFrame:
    """Models with most pending units at a period."""
    stock = _pending_stock(fact, year, spec, period, accent_sensitive)
    return stock.select(spec.model, UNITS).orderBy(*desc(UNITS), *asc(spec.model)).limit(limit)


def pending_total_series(
    model_series: DataFrame,
    models: Sequence[str] | None = None,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """``pending_model_series`` summed over all models, or over the chosen ones."""
    rows = model_series
    if models is not None:
        rows = rows.filter(F.col(spec.model).isin(list(models)) if models else F.lit(False))
    return sort_bounded(rows.groupBy(spec.period).agg(F.sum(UNITS).alias("valor")), *asc(spec.period))
