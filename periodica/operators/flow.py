"""From stocks to flows. Each operator states which convention it uses for a missing period."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.functions.frames import gather, sort_bounded
from periodica.functions.numbers import percent
from periodica.operators.pairs import (
    PREVIOUS,
    STOCK,
    STOCK_BEFORE,
    period_pairs,
    periods_of,
    positive_flow,
    with_period_before,
)
from periodica.operators.stock import stock_by
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, date_lit, desc


def _pair_flow() -> Column:
    flow = positive_flow(F.col(STOCK), F.col(STOCK_BEFORE))
    return F.when(F.col(PREVIOUS).isNull(), F.lit(0).cast("bigint")).otherwise(flow)


def annual_flow(fact: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Observed periods and summed positive model flows per calendar year."""
    return annual_flow_of_pairs(period_pairs(fact, [spec.model], spec, phantom_row=False), spec)


def annual_flow_of_pairs(pairs: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """``annual_flow`` from the pairs of each model; every observed period has some."""
    per_period = pairs.groupBy(spec.period).agg(F.sum(_pair_flow()).alias("fluxo"))
    # Gathered before the second grouping: one row per period.
    per_year = gather(per_period).groupBy(F.year(spec.period).alias("ano"))
    sums = per_year.agg(F.count(F.lit(1)).alias("meses_observados"), F.sum("fluxo").alias("vendas_total"))
    return sums.orderBy(*asc("ano"))


def base_builder_flow(fact: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Positive flow per model over all history, unordered."""
    return base_builder_flow_of_pairs(period_pairs(fact, [spec.model], spec), spec)


def base_builder_flow_of_pairs(pairs: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """``base_builder_flow`` from the pairs of each model, with the first period's row of no model."""
    return pairs.groupBy(spec.model).agg(F.sum(_pair_flow()).alias("vendas_proxy_total"))


def base_builder_ranking(
    fact: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC, limit: int | None = None
) -> DataFrame:
    """Models ranked by positive flow over all history."""
    ranked = base_builder_flow(fact, spec).orderBy(*desc("vendas_proxy_total"), *asc(spec.model))
    return ranked if limit is None else ranked.limit(limit)


# -- one model ----------------------------------------------------------------------------------


def model_series(fact: DataFrame, model: str, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Stock of one model at the periods in which it is present."""
    rows = fact.filter(F.col(spec.model) == model)
    return sort_bounded(stock_by(rows, spec.period, spec=spec, name="estoque"), *asc(spec.period))


def model_snapshot(
    fact: DataFrame, model: str, period: str | date, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Stock of one model at a period and the change since it was last present.

    The series is lagged over present periods only, so the first one counts whole. The window
    sees one row per period; the period is picked after it.
    """
    rows = fact.filter((F.col(spec.model) == model) & (F.col(spec.period) <= date_lit(period)))
    series = stock_by(rows, spec.period, spec=spec, name="estoque")
    before = F.lag("estoque").over(Window.orderBy(spec.period))
    lagged = series.withColumn("delta", F.col("estoque") - F.coalesce(before, F.lit(0)))
    return lagged.filter(F.col(spec.period) == date_lit(period))


def model_variation(
    fact: DataFrame,
    model: str,
    start: str | date,
    end: str | date,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Stock of one model at two named periods and the difference; NULL when one is missing."""
    period, units = F.col(spec.period), F.col(spec.measure)
    first, last = date_lit(start), date_lit(end)
    rows = fact.filter((F.col(spec.model) == model) & period.isin(first, last))
    sums = rows.agg(
        F.sum(F.when(period == first, units)).alias("inicio"),
        F.sum(F.when(period == last, units)).alias("fim"),
    )
    return sums.withColumn("variacao", F.col("fim") - F.col("inicio"))


def entries_proxy(
    fact: DataFrame,
    model: str,
    start: str | date | None = None,
    end: str | date | None = None,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Stock, net change and positive change of one model at every observed period.

    Periods without the model count 0; ``start`` and ``end`` cut the lagged series, which reads one period
    before ``start`` and none after ``end``.
    """
    fact = with_period_before(fact, start, end, spec)
    rows = fact.filter(F.col(spec.model) == model)
    stock = stock_by(rows, spec.period, spec=spec, name="estoque")
    # Both sides have at most one row per period.
    dense = periods_of(fact, spec).join(F.broadcast(stock), spec.period, "left").select(
        spec.period, F.coalesce("estoque", F.lit(0).cast("bigint")).alias("estoque")
    )
    change = F.col("estoque") - F.lag("estoque").over(Window.orderBy(spec.period))
    net = F.coalesce(change, F.lit(0).cast("bigint"))
    series = dense.withColumn("liquido", net).withColumn(
        "emplacamentos_proxy", F.greatest(F.col("liquido"), F.lit(0).cast("bigint"))
    )
    if start:
        series = series.filter(F.col(spec.period) >= date_lit(start))
    if end:
        series = series.filter(F.col(spec.period) <= date_lit(end))
    return series.orderBy(*asc(spec.period))


# -- country ------------------------------------------------------------------------------------


def national_snapshot(fact: DataFrame, period: str | date, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Country stock and its percentage change on the previous observed period.

    Only the period and the one before it are read: the latter is found from the period column.
    """
    ref = date_lit(period)
    earlier = fact.filter(F.col(spec.period) < ref).agg(F.max(spec.period)).scalar()
    two = fact.filter((F.col(spec.period) == ref) | (F.col(spec.period) == earlier))
    monthly = stock_by(two, spec.period, spec=spec, name="frota_total")
    before = F.lag("frota_total").over(Window.orderBy(spec.period))
    series = monthly.withColumn("mom_pct", percent(F.col("frota_total") - before, before))
    return series.filter(F.col(spec.period) == ref)
