"""Distinct codes by mergeable sketches: one HyperLogLog sketch for each period, united over any periods.

An exact count of distinct codes over several periods has to see the codes again; sketches of a few kilobytes are made once for each
period and united. The estimate is off by a relative standard error of 1.04 / sqrt(2^precision) at most; ``BOUND`` is
three of them, which holds in all but some 3 of 1,000 cases.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.spec import DEFAULT_SPEC, SnapshotSpec

#: Bits of a bucket number: 2^14 buckets, about 16 kB for a sketch that is full.
PRECISION = 14
BOUND = 3 * 1.04 / sqrt(1 << PRECISION)
SKETCH, MODELS = "esboco", "modelos_estimados"


def period_sketches(fact: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC, precision: int = PRECISION) -> DataFrame:
    """Rows, units and the sketch of the codes of each period; write it beside the fact and replace a period's row with the period."""
    return fact.groupBy(spec.period).agg(
        F.count(F.lit(1)).alias("linhas"),
        F.sum(spec.measure).alias("total"),
        F.hll_sketch_agg(spec.model, F.lit(precision)).alias(SKETCH),
    )


def distinct_models(sketches: DataFrame, *keys: Column) -> DataFrame:
    """Estimated distinct codes of all periods, or of the periods that share ``keys``, with periods, rows and units."""
    return sketches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periodos"),
        F.coalesce(F.sum("linhas"), F.lit(0).cast("bigint")).alias("linhas"),
        F.sum("total").alias("total"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(SKETCH)), F.lit(0).cast("bigint")).alias(MODELS),
    )


def within_bound(estimate: Column, exact: Column, bound: float = BOUND) -> Column:
    """Whether an estimate is as near to the exact count as stated; small counts may be off by one for rounding."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * F.lit(bound))
