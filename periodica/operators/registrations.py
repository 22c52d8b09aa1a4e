"""Registrations per period and model year, corrected for late model-year identification."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.functions.frames import gather
from periodica.operators.pairs import (
    PREVIOUS,
    SIDE,
    STOCK,
    STOCK_BEFORE,
    positive_flow,
    two_sided_stock,
    with_period_before,
)
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, date_lit

FLOW = "emplacamentos"
TOTAL = "emplacamentos_total"

# Stands for a NULL model year where rows of one group are told apart.
_NO_YEAR = -(2**31)


def adjusted_flow(fact: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Per (period, model, model year): raw positive flow, its corrected part, the model's flow.

    Units move from "year unknown" to a known year without being registered again. With P the
    positive flow of a model over known years and D the decrease of its unknown-year stock, each
    flow is scaled by max(P - D, 0) / P.

    The fact is aggregated once for all three stocks (per year, unknown year, whole model). The
    series of a model then share a partition, where each period's group has one row per year.
    """
    return adjusted_pairs(model_year_pairs(fact, spec), spec)


def model_year_pairs(fact: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Two-sided stock per (period, model, model year); a NULL model never pairs, a NULL year does."""
    return two_sided_stock(
        fact, [spec.model, spec.year], pairing=[spec.model], colocate=[spec.model], spec=spec
    )


def adjusted_pairs(pairs: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """``adjusted_flow`` of rows of ``model_year_pairs``."""
    zero = F.lit(0).cast("bigint")
    known = F.col(spec.year).isNotNull()
    now, before = (F.coalesce(F.col(c), zero) for c in (STOCK, STOCK_BEFORE))
    has_past = F.col(PREVIOUS).isNotNull()
    group = Window.partitionBy(spec.period, spec.model, SIDE)

    lowest_year = F.min(F.coalesce(F.col(spec.year), F.lit(_NO_YEAR))).over(group)
    raw = F.when(known & has_past, positive_flow(now, before)).otherwise(zero)
    grown = F.sum("bruto").over(group)
    unknown_drop = F.greatest(
        F.sum(F.when(~known, before - now).otherwise(zero)).over(group), zero
    )
    model_flow = F.when(has_past, F.greatest(F.sum(now - before).over(group), zero)).otherwise(zero)

    scaled = F.col("bruto").cast("double") * F.greatest(grown - unknown_drop, zero) / grown
    corrected = F.when(
        (F.col("bruto") > 0) & (grown > 0) & F.col(spec.model).isNotNull(), scaled
    ).otherwise(F.lit(0.0))
    first_of_group = F.coalesce(F.col(spec.year), F.lit(_NO_YEAR)) == lowest_year
    return pairs.withColumn("bruto", raw).select(
        spec.period,
        PREVIOUS,
        spec.model,
        spec.year,
        F.col("bruto"),
        corrected.alias(FLOW),
        # The model's own flow, carried by one row of each group so that it can be summed.
        F.when(first_of_group, model_flow).otherwise(zero).alias(TOTAL),
        (known & F.col(STOCK).isNotNull()).alias("_conhecido"),
        (known & F.col(STOCK_BEFORE).isNotNull()).alias("_conhecido_antes"),
    )


def registrations(
    fact: DataFrame,
    spec: SnapshotSpec = DEFAULT_SPEC,
    since: str | date | None = None,
    until: str | date | None = None,
) -> DataFrame:
    """Corrected flow per period and model year, with the uncorrected total of the period.

    Every period appears: one without known-year stock on either side of the comparison, such as
    the first, has a row with NULL model year and flow 0.

    With ``since`` and ``until`` only these periods are read, and the one observed before them: a flow looks
    back one observed period. The answer is that part of the unbounded one.
    """
    fact = with_period_before(fact, since, until, spec)
    return registrations_of_pairs(model_year_pairs(fact, spec), spec, since)


def registrations_of_pairs(
    pairs: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC, since: str | date | None = None, until: str | date | None = None
) -> DataFrame:
    """``registrations`` from rows of ``model_year_pairs``; every observed period has some."""
    if since is not None:
        pairs = pairs.filter(F.col(spec.period) >= date_lit(since))
    if until is not None:
        pairs = pairs.filter(F.col(spec.period) <= date_lit(until))
    yearly = adjusted_pairs(pairs, spec).groupBy(spec.period, spec.year).agg(
        F.sum(FLOW).alias(FLOW),
        F.sum(TOTAL).alias(TOTAL),
        F.max("_conhecido").alias("_conhecido"),
        F.max("_conhecido_antes").alias("_conhecido_antes"),
    )
    # One row per (period, model year) from here on: window and sort share one partition.
    whole = Window.partitionBy(spec.period)
    paired = F.max("_conhecido").over(whole) & F.max("_conhecido_antes").over(whole)
    first = F.row_number().over(whole.orderBy(F.col(spec.year).asc_nulls_first())) == 1
    found = F.struct(F.col(spec.year).alias("ano"), F.col(FLOW).alias("fluxo"))
    nothing = F.struct(F.lit(None).cast(dict(yearly.dtypes)[spec.year]).alias("ano"), F.lit(0.0).alias("fluxo"))
    summed = gather(yearly).select(
        spec.period,
        F.sum(TOTAL).over(whole).alias(TOTAL),
        paired.alias("_par"),
        # Each period gets a row without year, unless it has one.
        F.when(first & F.col(spec.year).isNotNull(), F.array(nothing, found)).otherwise(F.array(found)).alias("_linhas"),
    )
    return (
        summed.select("*", F.inline("_linhas"))
        .filter(F.col("ano").isNotNull() | ~F.col("_par"))
        .select(spec.period, F.col("ano").alias(spec.year), F.col("fluxo").alias(FLOW), TOTAL)
        .orderBy(*asc(spec.period, spec.year))
    )
