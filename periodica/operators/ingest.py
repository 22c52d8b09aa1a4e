"""From raw registry rows to consolidated snapshot rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.functions.numbers import parse_quantity, parse_year
from periodica.functions.rules import lookup
from periodica.functions.text import normalize_text, strip
from periodica.presets import Brand, BrandFilter
from periodica.sources.quarantine import REJECTED
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, date_lit


def filter_brand(rows: DataFrame, brand: BrandFilter, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    return rows.filter(brand.matches(F.col(spec.model)))


def canonical_code(code: Column, aliases: Mapping[str, str], normal: Column | None = None) -> Column:
    """Alias of the normalised code (``normal``, if there is one already), otherwise the stripped raw value with its case kept."""
    raw = strip(code)
    return lookup(normalize_text(code) if normal is None else normal, aliases, raw) if aliases else raw


def typed_rows(
    rows: DataFrame,
    brand: Brand,
    period: str | date,
    spec: SnapshotSpec = DEFAULT_SPEC,
    source: str | None = None,
    marks: Sequence[str] = (),
    normal: Column | None = None,
) -> DataFrame:
    """Trim and type canonical text columns; add the period and the file lineage.

    ``source`` names the origin when the frame has no lineage column of its own; columns named in ``marks`` are kept as they are.
    ``normal`` is the normalised code, for a caller that has it.
    """
    lineage = F.col(spec.lineage) if spec.lineage in rows.columns else F.lit(source).cast("string")
    return rows.select(
        date_lit(period).alias(spec.period),
        strip(F.col(spec.state)).alias(spec.state),
        strip(F.col(spec.city)).alias(spec.city),
        canonical_code(F.col(spec.model), brand.aliases, normal).alias(spec.model),
        parse_year(F.col(spec.year)).alias(spec.year),
        parse_quantity(F.col(spec.measure)).alias(spec.measure),
        lineage.alias(spec.lineage),
        *marks,
    )


def consolidate(rows: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """One row per (period, state, city, model, year, file) with the summed units."""
    keys = [c for c in spec.columns if c != spec.measure]
    return rows.groupBy(*keys).agg(F.sum(spec.measure).alias(spec.measure)).select(*spec.columns)


def count_input(rows: DataFrame, brand: BrandFilter, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows read and rows of the brand, as one row.

    An aggregate, not accumulator-based metrics: those count a map task again when a lost
    executor makes it rerun.
    """
    return rows.agg(
        F.count(F.lit(1)).alias("linhas_lidas"),
        F.count_if(brand.matches(F.col(spec.model))).alias("linhas_marca"),
    )


def counted_groups(
    rows: DataFrame,
    brand: Brand,
    period: str | date,
    spec: SnapshotSpec = DEFAULT_SPEC,
    marks: Sequence[str] = (),
    source: str | None = None,
) -> DataFrame:
    """The consolidation of all raw rows: groups of the brand, and everything else as one group.

    ``da_marca`` tells them apart and ``linhas`` counts the raw rows, so that one pass over the text gives
    both the rows to load and the counters of the input. Rows that differ in ``marks`` are counted apart; ``source`` is
    the lineage of a frame without such a column.
    """
    # Normalised once, for the filter and for the aliases.
    named = rows.withColumn("_normal", normalize_text(F.col(spec.model)))
    ours = F.coalesce(brand.filter.matches_normalized(F.col("_normal")), F.lit(False))
    typed = typed_rows(named.withColumn("_marca", ours).withColumns(
        {c: F.when(F.col("_marca"), F.col(c)) for c in rows.columns if c in spec.columns}
    ), brand, period, spec, source, marks, F.when(F.col("_marca"), F.col("_normal"))).withColumn("da_marca", F.col(spec.model).isNotNull())
    keys = [c for c in spec.columns if c != spec.measure]
    return typed.groupBy("da_marca", *marks, *keys).agg(
        F.sum(spec.measure).alias(spec.measure), F.count(F.lit(1)).alias("linhas")
    )


def counters(groups: DataFrame, *keys: str) -> DataFrame:
    """Rows read and rows of the brand, and rows rejected where ``counted_groups`` marked them; one row, or one for each of ``keys``."""
    rows, zero = F.col("linhas"), F.lit(0).cast("bigint")
    rejected = [F.coalesce(F.sum(F.when(F.col(REJECTED), rows)), zero).alias("linhas_rejeitadas")] if REJECTED in groups.columns else []
    return groups.groupBy(*keys).agg(
        F.coalesce(F.sum(rows), zero).alias("linhas_lidas"),
        F.coalesce(F.sum(F.when(F.col("da_marca"), rows)), zero).alias("linhas_marca"),
        *rejected,
    )


def reconcile(
    fact: DataFrame,
    period: str | date,
    previous: str | date,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Rows and units of a period against the previous one, in one pass over the two partitions."""
    current, before = date_lit(period), date_lit(previous)
    col, units = F.col(spec.period), F.col(spec.measure)
    zero = F.lit(0).cast("bigint")
    sums = fact.filter(col.isin(current, before)).agg(
        F.count_if(col == current).alias("linhas_consolidadas"),
        F.coalesce(F.sum(F.when(col == before, units)), zero).alias("total_anterior"),
        F.coalesce(F.sum(F.when(col == current, units)), zero).alias("total_atual"),
    )
    return sums.withColumn("delta", F.col("total_atual") - F.col("total_anterior"))
