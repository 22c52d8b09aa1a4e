"""Stock pairs kept up to date: flows are answered from a table that a monthly load changes in two periods.

The table holds the rows of ``registrations.model_year_pairs``, partitioned by period: the stock of each (model, model year)
next to its stock one observed period earlier. A pair depends on two periods, so replacing, inserting or emptying
period p changes the pairs that end in p and those that end in the period after it, and no others. ``refresh_pairs`` recomputes
these from three periods of the fact, however long the history is.

    replace_period(rows, facts, "2026-04-01")
    refresh_pairs(read_facts(spark, facts), pairs, ["2026-04-01"])
    registrations_of_pairs(read_pairs(spark, pairs))

The partitions of one refresh are swapped together when its job commits. If a job dies between the load and the refresh, the
table is behind: ``stale_periods`` finds by checksums which periods are, and refreshing those (or running the refresh again) mends it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.functions.frames import gather
from periodica.operators.flow import annual_flow_of_pairs, base_builder_flow_of_pairs
from periodica.operators.pairs import PREVIOUS, SIDE, STOCK, STOCK_BEFORE, phantom_pair
from periodica.operators.registrations import model_year_pairs
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, desc, to_date

#: Checksums weigh units by a hash below this.
_WEIGHTS = 1 << 20


def _columns(spec: SnapshotSpec) -> list[str]:
    return [spec.period, PREVIOUS, spec.model, spec.year, STOCK, STOCK_BEFORE, SIDE]


def _schema(spec: SnapshotSpec) -> str:
    types = ["date", "date", "string", "int", "bigint", "bigint", "int"]
    return ", ".join(f"`{c}` {t}" for c, t in zip(_columns(spec), types, strict=True))


def build_pairs(fact: DataFrame, path: str, spec: SnapshotSpec = DEFAULT_SPEC) -> None:
    """(Re)create the table of pairs at ``path`` from the whole fact."""
    _write(model_year_pairs(fact, spec), path, "static", spec)


def read_pairs(spark: SparkSession, path: str, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    return spark.read.schema(_schema(spec)).parquet(path)


def _write(pairs: DataFrame, path: str, mode: str, spec: SnapshotSpec) -> None:
    laid_out = pairs.select(_columns(spec)).hint("rebalance", spec.period).sortWithinPartitions(spec.period, spec.model, spec.year)
    laid_out.write.mode("overwrite").partitionBy(spec.period).option("partitionOverwriteMode", mode).parquet(path)


def affected_periods(observed: Iterable[date], changed: Iterable[date]) -> tuple[list[date], list[date]]:
    """Periods whose pairs a change touches, and the periods that these pairs are made of."""
    observed = sorted(set(observed))
    touched, needed = set(), set()
    for day in changed:
        after = bisect_right(observed, day)
        touched.update(observed[bisect_left(observed, day) : after + 1])
    for day in touched:
        at = bisect_left(observed, day)
        needed.update(observed[max(at - 1, 0) : at + 1])
    return sorted(touched), sorted(needed)


def observed_periods(fact: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> list[date]:
    """The calendar: one value per period of the table, read from the period column alone."""
    return sorted(r[0] for r in fact.select(spec.period).distinct().collect() if r[0] is not None)


def recomputed_pairs(fact: DataFrame, touched: list[date], needed: list[date], spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """The pairs that end in ``touched``. Only the periods ``needed`` are read, and each of the former follows its own last one."""
    part = fact.filter(F.col(spec.period).isin(needed))
    return model_year_pairs(part, spec).filter(F.col(spec.period).isin(touched))


def refresh_pairs(
    fact: DataFrame, path: str, changed: Iterable[str | date], spec: SnapshotSpec = DEFAULT_SPEC
) -> list[date]:
    """Bring the pairs at ``path`` up to date after ``changed`` periods of ``fact`` were replaced, inserted or emptied.

    Returns the periods that were recomputed. Running it again gives the same table; periods that have not
    changed may be named too. ``fact`` has to be read after the change.
    """
    days = sorted({to_date(c) for c in changed})
    observed = observed_periods(fact, spec)
    touched, needed = affected_periods(observed, days)
    if touched:
        _write(recomputed_pairs(fact, touched, needed, spec), path, "dynamic", spec)
    for day in days:
        if day not in observed:
            # A partition without rows is not swapped by the job above.
            empty = fact.sparkSession.createDataFrame([], _schema(spec)).drop(spec.period)
            empty.write.mode("overwrite").parquet(f"{path}/{spec.period}={day.isoformat()}")
    return touched


# -- answers ------------------------------------------------------------------------------------


def model_pairs(pairs: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Pairs of whole models: absent sides count 0, and the sides of rows without model stay apart."""
    zero = F.lit(0).cast("bigint")
    sums = (F.sum(F.coalesce(F.col(c), zero)).alias(c) for c in (STOCK, STOCK_BEFORE))
    return pairs.groupBy(spec.period, PREVIOUS, spec.model, SIDE).agg(*sums).drop(SIDE)


def annual_flow_kept(pairs: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """``flow.annual_flow`` from the table of pairs."""
    return annual_flow_of_pairs(model_pairs(pairs, spec), spec)


def base_builder_kept(pairs: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC, limit: int | None = None) -> DataFrame:
    """``flow.base_builder_ranking`` from the table of pairs."""
    periods = pairs.select(spec.period, PREVIOUS).distinct()
    rows = model_pairs(pairs, spec).unionByName(phantom_pair(periods, {spec.model: "string"}, spec))
    ranked = base_builder_flow_of_pairs(rows, spec).orderBy(*desc("vendas_proxy_total"), *asc(spec.model))
    return ranked if limit is None else ranked.limit(limit)


# -- audit --------------------------------------------------------------------------------------


def _checksums(rows: DataFrame, units: str, name: str, spec: SnapshotSpec) -> list[Column]:
    """Sum of the units, and sum of the units weighed by a hash of their key: both the same for parted and summed rows."""
    weight = F.pmod(F.xxhash64(spec.model, spec.year), F.lit(_WEIGHTS)).cast("decimal(10,0)")
    exact = F.col(units).cast("decimal(20,0)")
    return [F.sum(exact).alias(name), F.sum((exact * weight).cast("decimal(38,0)")).alias(f"{name}_chave")]


def stale_periods(fact: DataFrame, pairs: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Periods whose pairs do not belong to the fact as it is: missing, left over, with another predecessor or other sums.

    One pass over each table. Sums are compared by period, so a difference that leaves all of a period's weighed sums as they are
    is not found; that takes a coincidence of hashes.
    """
    known = fact.filter(F.col(spec.period).isNotNull())
    sums = known.groupBy(spec.period).agg(*_checksums(known, spec.measure, "soma", spec))
    order = Window.orderBy(spec.period)
    before = [F.lag(c).over(order).alias(f"{c}_antes") for c in (spec.period, "soma", "soma_chave")]
    wanted = gather(sums).select(spec.period, "soma", "soma_chave", *before)
    kept = pairs.groupBy(spec.period).agg(
        F.max(PREVIOUS).alias("anterior"),
        *_checksums(pairs, STOCK, "par", spec),
        *_checksums(pairs, STOCK_BEFORE, "par_antes", spec),
    ).filter(F.col("par").isNotNull() | F.col("par_antes").isNotNull())
    same = [
        F.col("soma").eqNullSafe(F.col("par")),
        F.col("soma_chave").eqNullSafe(F.col("par_chave")),
        F.col("soma_antes").eqNullSafe(F.col("par_antes")),
        F.col("soma_chave_antes").eqNullSafe(F.col("par_antes_chave")),
        F.col(f"{spec.period}_antes").eqNullSafe(F.col("anterior")),
    ]
    joined = wanted.join(kept, spec.period, "full")
    return joined.filter(~(same[0] & same[1] & same[2] & same[3] & same[4])).select(spec.period).orderBy(*asc(spec.period))
