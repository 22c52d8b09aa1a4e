"""Growth of chosen model years by state or city."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.functions.text import title_case
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, date_lit, desc

STATE_LEVEL = "uf"
CITY_LEVEL = "municipio"


def territory(
    fact: DataFrame,
    years: Sequence[int],
    period: str | date,
    granularity: str = STATE_LEVEL,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Current and previous stock, net change and gain per state, or per (state, city).

    The previous period is the latest of the whole table before the reference; without one,
    the gain is the whole stock. Both periods are read in one scan whose partitions are pruned
    at run time, and one conditional aggregation replaces the join of two aggregates.
    """
    keys = [spec.state] if granularity == STATE_LEVEL else [spec.state, spec.city]
    return _ordered(_changes(_two_periods(fact, years, period, keys, spec), keys), keys)


_SUMS = ("_atual", "_anterior", "_linhas_atual", "_linhas_anterior")


def _two_periods(
    fact: DataFrame, years: Sequence[int], period: str | date, keys: Sequence[str], spec: SnapshotSpec
) -> DataFrame:
    """Units and rows of the chosen years per place, at the reference and at the period before it."""
    ref, when = date_lit(period), F.col(spec.period)
    previous = fact.filter(when < ref).agg(F.max(spec.period)).scalar()
    chosen = F.col(spec.year).isin([int(y) for y in years]) if years else F.lit(False)
    rows = fact.filter(((when == ref) | (when == previous)) & chosen)
    units, zero = F.col(spec.measure).cast("bigint"), F.lit(0).cast("bigint")
    return rows.groupBy(*keys).agg(
        F.sum(F.when(when == ref, units).otherwise(zero)).alias("_atual"),
        F.sum(F.when(when == ref, zero).otherwise(units)).alias("_anterior"),
        F.count_if(when == ref).alias("_linhas_atual"),
        F.count_if(when != ref).alias("_linhas_anterior"),
    )


def _changes(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals and changes per place. Places with a missing name do not pair across the two periods."""
    unnamed = F.lit(False)
    for key in keys:
        unnamed = unnamed | F.col(key).isNull()
    zero = F.lit(0).cast("bigint")

    def side(now: Column, before: Column) -> Column:
        return F.struct(now.alias("total_atual"), before.alias("total_anterior"))

    apart = F.array(
        F.when(F.col("_linhas_atual") > 0, side(F.col("_atual"), zero)),
        F.when(F.col("_linhas_anterior") > 0, side(zero, F.col("_anterior"))),
    )
    sides = F.when(unnamed, F.array_compact(apart)).otherwise(F.array(side(F.col("_atual"), F.col("_anterior"))))
    net = F.col("total_atual") - F.col("total_anterior")
    return sums.select(*keys, F.inline(sides)).select(
        *keys,
        "total_atual",
        "total_anterior",
        net.alias("delta_liquido"),
        F.greatest(net, zero).alias("ganho_mensal"),
    )


def _ordered(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return changes.orderBy(*desc("ganho_mensal", "total_atual"), *asc(*keys))


def state_leaders(states: DataFrame, limit: int = 12, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """First rows of the state frame, labelled, with the units of the whole slice."""
    # One row per state: the whole is summed where they are.
    whole = F.coalesce(F.sum("total_atual").over(Window.partitionBy(F.lit(0))), F.lit(0).cast("bigint"))
    top = states.withColumn("total_recorte", whole).orderBy(*desc("ganho_mensal", "total_atual"), *asc(spec.state)).limit(limit)
    return top.select(
        title_case(F.col(spec.state)).alias("territorio"),
        "ganho_mensal",
        "total_atual",
        "delta_liquido",
        "total_recorte",
    )


def city_leaders(cities: DataFrame, limit: int = 15, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """First rows of the city frame, nameless cities dropped after the cut, as ``City / State``."""
    order = desc("ganho_mensal", "total_atual") + asc(spec.state, spec.city)
    top = cities.orderBy(*order).limit(limit)
    named = top.filter(F.col(spec.city).isNotNull())
    label = F.concat_ws(" / ", title_case(F.col(spec.city)), title_case(F.col(spec.state)))
    return named.select(label.alias("territorio"), "ganho_mensal", "total_atual", "delta_liquido")


def territory_leaders(
    fact: DataFrame,
    years: Sequence[int],
    period: str | date,
    states: int = 12,
    cities: int = 15,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Leading states and cities in one frame, told apart by ``nivel``.

    The fact is scanned and summed once, by city; states are sums of that.
    """
    places = [spec.state, spec.city]
    sums = _two_periods(fact, years, period, places, spec)
    state_sums = sums.groupBy(spec.state).agg(*(F.sum(c).alias(c) for c in _SUMS))
    by_state = _changes(state_sums, [spec.state])
    by_city = _changes(sums, places)
    top_states = state_leaders(by_state, states, spec).withColumn("nivel", F.lit(STATE_LEVEL))
    top_cities = city_leaders(by_city, cities, spec).withColumn("nivel", F.lit(CITY_LEVEL))
    both = top_states.unionByName(top_cities, allowMissingColumns=True)
    return both.orderBy(*desc("nivel", "ganho_mensal", "total_atual"), *asc("territorio"))
