"""Load one month of registry files into the fact table."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.functions.frames import gather
from periodica.operators.ingest import count_input, counted_groups, counters, reconcile
from periodica.plans.kept_pairs import refresh_pairs
from periodica.presets import Brand
from periodica.session import release_shuffles, shared_folder
from periodica.sources.facts import read_facts, replace_period, replace_periods
from periodica.sources.quarantine import DETAIL, REJECTED, read_registry_files, set_aside
from periodica.sources.registry import canonicalize, read_registry
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, date_lit, to_date

_SOURCE = "_fonte"


@dataclass(frozen=True)
class StagedLoad:
    """Texts that were read, cleaned and consolidated, in the shared folder: tables may be loaded from them, and loaded again, without the texts."""

    groups: DataFrame
    rejected: int | None
    periods: tuple[str | date, ...]


def load_month(
    spark: SparkSession,
    source: str,
    path: str | None,
    period: str | date,
    previous: str | date,
    brand: Brand,
    spec: SnapshotSpec = DEFAULT_SPEC,
    *,
    table: str | None = None,
    pairs: str | None = None,
    quarantine: str | None = None,
    max_rejected: int = 0,
    lineage: str | None = None,
) -> DataFrame:
    """Read, clean, consolidate and replace one period; returns the reconciliation as one row.

    The target is a ``path`` or a catalog ``table``; a table of stock pairs at ``pairs`` is brought up to date with it. The text
    is read once: its consolidation, with the counters of the input, is written to the shared folder, and both the
    partition and the report come from there.

    Files of another header and malformed records fail the load, unless there is a folder for the ``quarantine``: then each
    header is read by itself, malformed records go to that folder with file and line, and the report has
    ``linhas_rejeitadas``, which ``linhas_lidas`` includes. More than ``max_rejected`` of them fail the load, before the period
    is replaced; the lines are counted again for them, without being parsed, only if there are any.

    Rows are summed by file, and carry its path, unless ``lineage`` names the delivery that all files are parts of.
    """
    staged = stage_months(spark, {period: source}, brand, spec, quarantine=quarantine, max_rejected=max_rejected, lineage=lineage)
    return load_staged_month(staged, path, previous, spec, table=table, pairs=pairs)


def load_staged_month(
    staged: StagedLoad,
    path: str | None,
    previous: str | date,
    spec: SnapshotSpec = DEFAULT_SPEC,
    *,
    table: str | None = None,
    pairs: str | None = None,
) -> DataFrame:
    """``load_month`` of the one period that ``stage_months`` has staged."""
    (period,), groups, rejected = staged.periods, staged.groups, staged.rejected
    spark = groups.sparkSession
    replace_period(groups.filter("da_marca"), path, period, spec, table=table)
    release_shuffles(spark)
    fact = read_facts(spark, path, spec, table=table)
    if pairs is not None:
        refresh_pairs(fact, pairs, [period], spec)
    report = _report(counters(groups), fact, period, previous, spec)
    return report if rejected is None else report.withColumn("linhas_rejeitadas", F.lit(rejected).cast("bigint"))


def load_months(
    spark: SparkSession,
    sources: Mapping[str | date, str | Sequence[str]],
    path: str | None,
    brand: Brand,
    spec: SnapshotSpec = DEFAULT_SPEC,
    *,
    table: str | None = None,
    pairs: str | None = None,
    quarantine: str | None = None,
    max_rejected: int = 0,
    lineage: str | None = None,
) -> DataFrame:
    """Load the periods of ``sources`` (period to text files) together; returns the reconciliation, one row for each.

    As ``load_month`` for each, but in one job for the texts and one for the table, whose periods are swapped together: a failed
    attempt leaves all of them, and running it again gives the same table. Each period is compared with the one observed before it once
    all are loaded; NULL where there is none.
    """
    staged = stage_months(spark, sources, brand, spec, quarantine=quarantine, max_rejected=max_rejected, lineage=lineage)
    return load_staged_months(staged, path, spec, table=table, pairs=pairs)


def load_staged_months(
    staged: StagedLoad,
    path: str | None,
    spec: SnapshotSpec = DEFAULT_SPEC,
    *,
    table: str | None = None,
    pairs: str | None = None,
) -> DataFrame:
    """``load_months`` of the periods that ``stage_months`` has staged."""
    groups, rejected = staged.groups, staged.rejected
    spark = groups.sparkSession
    replace_periods(groups.filter("da_marca"), path, staged.periods, spec, table=table)
    release_shuffles(spark)
    fact = read_facts(spark, path, spec, table=table)
    days = sorted(to_date(d) for d in staged.periods)
    if pairs is not None:
        refresh_pairs(fact, pairs, days, spec)
    # One row per period from here on.
    units = fact.groupBy(spec.period).agg(F.count(F.lit(1)).alias("linhas_consolidadas"), F.sum(spec.measure).alias("total_atual"))
    before = F.lag("total_atual").over(Window.orderBy(spec.period))
    totals = gather(units).withColumn("total_anterior", before).filter(F.col(spec.period).isin(days))
    counts = counters(groups, spec.period)
    zero = F.lit(0).cast("bigint")
    # From a literal: a list of Python's would be sent through Python workers.
    named = spark.range(1).select(F.explode(F.array(*map(date_lit, days))).alias(spec.period))
    found = named.join(counts, spec.period, "left").join(totals, spec.period, "left").select(
        spec.period,
        *(F.coalesce(c, zero).alias(c) for c in ("linhas_lidas", "linhas_marca", "linhas_consolidadas")),
        "total_anterior",
        F.coalesce("total_atual", zero).alias("total_atual"),
        (F.coalesce("total_atual", zero) - F.col("total_anterior")).alias("delta"),
        *([F.coalesce("linhas_rejeitadas", zero).alias("linhas_rejeitadas")] if rejected is not None else []),
    )
    return found.orderBy(*asc(spec.period))


def stage_months(
    spark: SparkSession,
    sources: Mapping[str | date, str | Sequence[str]],
    brand: Brand,
    spec: SnapshotSpec = DEFAULT_SPEC,
    *,
    quarantine: str | None = None,
    max_rejected: int = 0,
    lineage: str | None = None,
) -> StagedLoad:
    """``counted_groups`` of all sources, written in one job, and the number of rejected records, which are set aside.

    A malformed record is a group of its own there, with its text, so that the quarantine is written from what was parsed.
    """
    path = f"{shared_folder(spark)}/periodica-{spark.sparkContext.applicationId}/carga-{uuid.uuid4().hex[:12]}"
    parts, files = [], []
    for number, (period, source) in enumerate(sources.items()):
        if quarantine is None:
            raw, marks = canonicalize(read_registry(spark, source, spec=spec), spec), []
        else:
            files.append(read_registry_files(spark, source, spec=spec))
            raw, marks = files[-1].detailed.withColumn(_SOURCE, F.lit(number)), [REJECTED, DETAIL, _SOURCE]
        if lineage is not None:
            raw = raw.drop(spec.lineage)
        parts.append(counted_groups(raw, brand, period, spec, marks, lineage))
    reduce(DataFrame.unionByName, parts).write.parquet(path)
    release_shuffles(spark)
    groups = spark.read.parquet(path)
    if quarantine is None:
        return StagedLoad(groups, None, tuple(sources))
    bad = groups.filter(REJECTED)
    rejected = bad.agg(F.sum("linhas")).first()[0] or 0
    set_aside(files, rejected, quarantine, max_rejected, [bad.filter(F.col(_SOURCE) == n).select(DETAIL) for n in range(len(files))])
    return StagedLoad(groups, rejected, tuple(sources))


def load_report(
    raw: DataFrame,
    fact: DataFrame,
    period: str | date,
    previous: str | date,
    brand: Brand,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Input counts of raw rows next to the reconciliation of the loaded period with the previous one."""
    return _report(count_input(raw, brand.filter, spec), fact, period, previous, spec)


def _report(counts: DataFrame, fact: DataFrame, period, previous, spec: SnapshotSpec) -> DataFrame:
    return reconcile(fact, period, previous, spec).select(
        counts.select("linhas_lidas").scalar().alias("linhas_lidas"),
        counts.select("linhas_marca").scalar().alias("linhas_marca"),
        "linhas_consolidadas",
        "total_anterior",
        "total_atual",
        "delta",
    )
