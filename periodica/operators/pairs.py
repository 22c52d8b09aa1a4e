"""Stock of a key next to its stock one observed period earlier."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.operators.stock import stock_by
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, date_lit

PREVIOUS = "competencia_anterior"
STOCK = "estoque_atual"
STOCK_BEFORE = "estoque_anterior"
_NEXT = "_proxima"
SIDE = "_lado"


def calendar(stock: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Observed periods with their neighbours, from a stock by period and keys: one row per period, whatever its size.

    The periods are a by-product of the stock: as the neighbours refer to a count of its sums, this branch is the same up
    to the shuffle of the stock as the one that joins it, and reads that shuffle again instead of the table. The join is to be a
    left one: an inner join may prune its left branch's scan by the calendar, and would tell the two branches apart.
    """
    order = Window.orderBy(spec.period)
    periods = stock.groupBy(spec.period).agg(F.count(STOCK).alias("_somas"))
    counted = F.col("_somas") >= 0  # always so
    return periods.select(
        spec.period,
        F.when(counted, F.lag(spec.period).over(order)).alias(PREVIOUS),
        F.when(counted, F.lead(spec.period).over(order)).alias(_NEXT),
    )


def periods_of(fact: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Observed periods."""
    return fact.select(spec.period).distinct()


def with_period_before(
    fact: DataFrame, since: str | date | None, until: str | date | None, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Rows of the periods from the last one observed before ``since`` to ``until``.

    The earlier period is found from the period column alone, and both bounds prune partitions.
    """
    period = F.col(spec.period)
    if until is not None:
        fact = fact.filter(period <= date_lit(until))
    if since is None:
        return fact
    first = date_lit(since)
    before = fact.filter(period < first).agg(F.max(spec.period)).scalar()
    return fact.filter(period >= F.coalesce(before, first))


def _totals(fact: DataFrame, keys: Sequence[str], spec: SnapshotSpec) -> DataFrame:
    """Stock per (period, keys). Rows without period are dropped here, where the joins with the calendar would do it."""
    return stock_by(fact.filter(F.col(spec.period).isNotNull()), spec.period, *keys, spec=spec, name=STOCK)


def two_sided_stock(
    fact: DataFrame,
    keys: Sequence[str],
    pairing: Sequence[str],
    colocate: Sequence[str],
    spec: SnapshotSpec,
) -> DataFrame:
    """Stock of each key at a period and at the period before; absent sides are NULL.

    Equals the full outer join of the stock with itself one period later, in two shuffles of
    aggregated rows: map-side combined sums per (period, keys), then the series of each key
    side by side, where LAG finds the earlier stock and LEAD tells whether the key is missing
    from the next period and owes it a row. A series has one row per period at most, however
    many raw rows its key has. ``colocate``, a part of ``keys``, is what the second shuffle hashes, so
    that a later grouping by it needs no third one.

    A key with a NULL in ``pairing`` never matches itself, as in an equality join: its two sides
    stay apart, told by the side number.
    """
    unmatched = F.lit(False)
    for key in pairing:
        unmatched = unmatched | F.col(key).isNull()
    totals = _totals(fact, keys, spec)
    # One row per period: bounded by the calendar, not by the table.
    stock = totals.join(F.broadcast(calendar(totals, spec)), spec.period, "left")
    series = Window.partitionBy(*keys).orderBy(spec.period)
    dated = stock.repartition(*(F.col(c) for c in colocate)).select(
        spec.period,
        PREVIOUS,
        _NEXT,
        *keys,
        STOCK,
        F.lag(spec.period).over(series).alias("_visto"),
        F.lag(STOCK).over(series).alias("_visto_estoque"),
        F.lead(spec.period).over(series).alias("_volta"),
    )
    adjacent = ~unmatched & (F.col("_visto") == F.col(PREVIOUS))
    kept = ~unmatched & (F.col("_volta") == F.col(_NEXT))
    missing_next = F.when(~F.coalesce(kept, F.lit(False)), F.col(_NEXT))

    def row(period: Column, before: Column, now: Column, then: Column, side: Column) -> Column:
        return F.struct(
            period.alias("p"), before.alias("b"), now.alias("now"), then.alias("then"), side.alias("side")
        )

    nothing, paired = F.lit(None).cast("bigint"), F.lit(0)
    found = F.when(adjacent, F.col("_visto_estoque"))
    halves = F.array(
        row(F.col(spec.period), F.col(PREVIOUS), F.col(STOCK), found, paired),
        row(missing_next, F.col(spec.period), nothing, F.col(STOCK), F.when(unmatched, F.lit(1)).otherwise(paired)),
    )
    return dated.select(*keys, F.inline(halves)).filter(F.col("p").isNotNull()).select(
        F.col("p").alias(spec.period),
        F.col("b").alias(PREVIOUS),
        *keys,
        F.col("now").alias(STOCK),
        F.col("then").alias(STOCK_BEFORE),
        F.col("side").alias(SIDE),
    )


def period_pairs(
    fact: DataFrame,
    keys: Sequence[str],
    spec: SnapshotSpec = DEFAULT_SPEC,
    phantom_row: bool = True,
) -> DataFrame:
    """Stock per (period, keys) next to the stock at the previous observed period.

    A key absent on one side counts 0 there; a key with a NULL never pairs. The first period has
    no previous one and contributes a row of NULL keys with stock 0, as an outer join would;
    sums do not need it, and leaving it out keeps the partitioning by ``keys``.
    """
    pairs = two_sided_stock(fact, keys, keys, keys, spec).select(
        spec.period,
        PREVIOUS,
        *keys,
        *(F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in (STOCK, STOCK_BEFORE)),
    )
    if not phantom_row:
        return pairs
    types = dict(fact.select(*keys).dtypes)
    return pairs.unionByName(phantom_pair(calendar(_totals(fact, keys, spec), spec), {k: types[k] for k in keys}, spec))


def phantom_pair(periods: DataFrame, keys: dict[str, str], spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """The row that the first of ``periods`` (with ``PREVIOUS``) adds: NULL ``keys`` (name and type) and stock 0."""
    return periods.filter(F.col(PREVIOUS).isNull()).select(
        spec.period,
        PREVIOUS,
        *(F.lit(None).cast(t).alias(k) for k, t in keys.items()),
        *(F.lit(0).cast("bigint").alias(c) for c in (STOCK, STOCK_BEFORE)),
    )


def positive_flow(stock: Column, before: Column) -> Column:
    return F.greatest(stock - before, F.lit(0).cast("bigint"))
