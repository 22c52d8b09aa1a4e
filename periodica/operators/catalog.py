"""Listings of what the fact table holds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.functions.frames import sort_bounded
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, to_date


def list_periods(fact: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    return sort_bounded(fact.select(spec.period).distinct(), *asc(spec.period))


def list_years(fact: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    known = fact.select(spec.year).filter(F.col(spec.year).isNotNull())
    return sort_bounded(known.distinct(), *asc(spec.year))


def valid_years(fact: DataFrame, period: str | date, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Model years that are not later than the year of the reference period."""
    return list_years(fact, spec).filter(F.col(spec.year) <= to_date(period).year)


def info(fact: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC, approximate: bool = False) -> DataFrame:
    """First and last period, rows, distinct models (``approximate`` trades exactness for one pass)."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return fact.agg(
        F.min(spec.period).alias("primeira_competencia"),
        F.max(spec.period).alias("ultima_competencia"),
        F.count(F.lit(1)).alias("linhas"),
        distinct(F.col(spec.model)).alias("modelos_distintos"),
    )
