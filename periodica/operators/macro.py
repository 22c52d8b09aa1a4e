"""Bucketed series and residuals over the frame that ``registrations`` or ``trailing_registrations`` returns.

These work on one row per (period, model year). Each derives what it needs in one aggregation
per bucket instead of joining series that come from the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.functions.dates import bucket_label, bucket_start, first_trailing_month, within_trailing_months
from periodica.operators.registrations import FLOW, TOTAL, registrations
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, desc, to_date

START = "period_start"
LABEL = "period_label"
SERIES = "serie"
BUCKET = [START, LABEL]

# Names of the derived series.
TOTAL_SERIES = "Total"
OTHER_YEARS = "Outros MYs"
UNIDENTIFIED = "MY nao identificado"
YEAR_PREFIX = "MY "


def trailing_registrations(
    fact: DataFrame, end: str | date, months: int | None = None, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """``registrations`` of the last ``months`` months up to ``end``; no other period is read but the one before."""
    return registrations(fact, spec, since=first_trailing_month(end, months), until=end)


def trailing_window(
    flows: DataFrame,
    end: str | date,
    months: int | None = None,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """The last ``months`` months up to ``end``, or everything up to ``end``."""
    kept = flows.filter(within_trailing_months(F.col(spec.period), end, months))
    return kept.orderBy(*asc(spec.period, spec.year))


def bucketed(
    flows: DataFrame,
    end: str | date,
    grain: str = "month",
    months: int | None = None,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Trailing window with the start and the label of each row's bucket."""
    kept = flows.filter(within_trailing_months(F.col(spec.period), end, months))
    period = F.col(spec.period)
    return kept.withColumns(
        {START: bucket_start(period, grain), LABEL: bucket_label(period, grain)}
    )


def flow_by_bucket_and_year(rows: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Flow per (bucket, known model year)."""
    known = rows.filter(F.col(spec.year).isNotNull())
    return known.groupBy(*BUCKET, spec.year).agg(F.sum(FLOW).alias(FLOW)).orderBy(*asc(START, spec.year))


def _bucket_sums(
    rows: DataFrame, selected: Sequence[int] = (), spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Per bucket: whole flow, flow attributed to known years, flow of the selected years."""
    year = F.col(spec.year)
    chosen = year.isin(list(selected)) if selected else F.lit(False)
    # The period total is repeated on the rows of a period: take it once per period first.
    per_period = rows.groupBy(*BUCKET, spec.period).agg(
        F.max(TOTAL).alias(TOTAL),
        F.sum(F.when(year.isNotNull(), F.col(FLOW)).otherwise(F.lit(0.0))).alias("atribuido"),
        F.sum(F.when(chosen, F.col(FLOW)).otherwise(F.lit(0.0))).alias("selecionado"),
    )
    return per_period.groupBy(*BUCKET).agg(
        *(F.sum(c).alias(c) for c in (TOTAL, "atribuido", "selecionado"))
    )


def _series(sums: DataFrame, value: Column, name: str) -> DataFrame:
    return sums.select(*BUCKET, value.alias(FLOW), F.lit(name).alias(SERIES)).orderBy(*asc(START))


def total_by_bucket(
    rows: DataFrame, name: str = TOTAL_SERIES, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Whole flow per bucket, each period's total counted once."""
    return _series(_bucket_sums(rows, spec=spec), F.col(TOTAL), name)


def _unattributed() -> Column:
    return F.greatest(F.col(TOTAL).cast("double") - F.col("atribuido"), F.lit(0.0))


def unattributed_by_bucket(
    rows: DataFrame, name: str = UNIDENTIFIED, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Flow of the bucket that no known model year accounts for, never negative."""
    return _series(_bucket_sums(rows, spec=spec), _unattributed(), name)


def active_years(rows: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Model years with positive flow in at least one bucket."""
    by_year = flow_by_bucket_and_year(rows, spec)
    return by_year.filter(F.col(FLOW) > 0).select(spec.year).distinct().orderBy(*asc(spec.year))


def default_years(
    rows: DataFrame, end: str | date, limit: int = 3, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Newest active years not older than two years before ``end``; without any, the newest."""
    recent = F.col(spec.year) >= to_date(end).year - 2
    # One row per active model year.
    any_recent = F.max(recent).over(Window.partitionBy(F.lit(0)))
    candidates = active_years(rows, spec).withColumn("_recente", recent).withColumn("_ha_recente", any_recent)
    newest = candidates.filter(F.col("_recente") | ~F.col("_ha_recente")).select(spec.year)
    return newest.orderBy(*desc(spec.year)).limit(limit).orderBy(*asc(spec.year))


def selected_years_dense(
    rows: DataFrame, years: Sequence[int], spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Flow of each selected year in every bucket, 0 where it has none."""
    year, flow = F.col(spec.year), F.col(FLOW)
    kind = dict(rows.dtypes)[spec.year]
    per_bucket = rows.groupBy(*BUCKET).agg(
        *(
            F.sum(F.when(year == y, flow).otherwise(F.lit(0.0))).alias(f"_{y}")
            for y in years
        ),
        F.count(F.lit(1)).alias("_n"),
    )
    entries = F.array(
        *(
            F.struct(
                F.lit(int(y)).cast(kind).alias(spec.year),
                F.col(f"_{y}").alias(FLOW),
                F.lit(f"{YEAR_PREFIX}{int(y)}").alias(SERIES),
            )
            for y in years
        )
    )
    if not years:
        entries = entries.cast(f"array<struct<{spec.year}:{kind},{FLOW}:double,{SERIES}:string>>")
    return per_bucket.select(*BUCKET, F.inline(entries)).orderBy(*asc(START, spec.year))


def residual_series(
    rows: DataFrame, years: Sequence[int], spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """What the selected years leave: other known years, and flow of no known year."""
    other = F.greatest(F.col("atribuido") - F.col("selecionado"), F.lit(0.0))
    entries = F.array(
        F.struct(other.alias(FLOW), F.lit(OTHER_YEARS).alias(SERIES)),
        F.struct(_unattributed().alias(FLOW), F.lit(UNIDENTIFIED).alias(SERIES)),
    )
    sums = _bucket_sums(rows, years, spec)
    return sums.select(*BUCKET, F.inline(entries)).orderBy(*asc(START, SERIES))
