"""Model-by-month matrices and their long form."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.functions.dates import MONTHS
from periodica.operators.stock import stock_by
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, date_lit, desc, to_date

DISPLAY = "nome_exibicao"
ALL_MODELS = "Todos os modelos"


def _month_columns(value: Column, period: Column, cutoff: int) -> list[Column]:
    """Twelve conditional sums: months without data are 0 up to the cutoff and NULL after it.

    One aggregation on the model; a pivot would group by (model, month) first and shuffle twice.
    """
    nothing = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return [
        (
            F.coalesce(F.sum(F.when(F.month(period) == number, value)), zero)
            if number <= cutoff
            else F.max(nothing)
        ).alias(name)
        for number, name in enumerate(MONTHS, 1)
    ]


def _chosen(fact: DataFrame, years: Sequence[int], spec: SnapshotSpec) -> DataFrame:
    chosen = F.col(spec.year).isin([int(y) for y in years]) if years else F.lit(False)
    return fact.filter(chosen & F.col(spec.model).isNotNull())


def stock_matrix(
    fact: DataFrame,
    years: Sequence[int],
    period: str | date,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Stock of the chosen model years per model and month of the reference year.

    Models without a row in that year up to the reference period are absent. Sorted by the
    reference month.
    """
    ref = to_date(period)
    in_year = F.col(spec.period).between(date_lit(date(ref.year, 1, 1)), date_lit(ref))
    columns = _month_columns(F.col(spec.measure).cast("bigint"), F.col(spec.period), ref.month)
    matrix = _chosen(fact, years, spec).filter(in_year).groupBy(spec.model).agg(*columns)
    return matrix.orderBy(*desc(MONTHS[ref.month - 1]), *asc(spec.model))


def flow_matrix(
    fact: DataFrame,
    years: Sequence[int],
    period: str | date,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Positive flow of the chosen model years per model and month of the reference year.

    The change is taken against the model's previous present period, over all history. The lag
    partitions pre-aggregated rows by model, at most one per period, and the month columns are
    then grouped in the same partitioning. Sorted by row total.
    """
    ref = to_date(period)
    rows = _chosen(fact, years, spec).filter(F.col(spec.period) <= date_lit(ref))
    series = stock_by(rows, spec.model, spec.period, spec=spec, name="estoque")
    before = F.lag("estoque").over(Window.partitionBy(spec.model).orderBy(spec.period))
    zero = F.lit(0).cast("bigint")
    flow = F.greatest(F.col("estoque") - F.coalesce(before, zero), zero)
    in_year = F.col(spec.period) >= date_lit(date(ref.year, 1, 1))
    flows = series.withColumn("fluxo", flow).filter(in_year)
    matrix = flows.groupBy(spec.model).agg(*_month_columns(F.col("fluxo"), F.col(spec.period), ref.month))
    row_total = sum((F.col(m) for m in MONTHS[1 : ref.month]), F.col(MONTHS[0]))
    return matrix.orderBy(row_total.desc_nulls_last(), *asc(spec.model))


def _name_column(matrix: DataFrame, spec: SnapshotSpec) -> str:
    return DISPLAY if DISPLAY in matrix.columns else spec.model


def _month_number(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), c)


def matrix_series(
    matrix: DataFrame,
    top_n: int = 8,
    selected: Sequence[str] | None = None,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Long form of a matrix: the ``top_n`` rows by row sum, or the named rows, NULL cells dropped."""
    name = _name_column(matrix, spec)
    months = [m for m in MONTHS if m in matrix.columns]
    rows = matrix.select(F.col(name).alias("serie"), *months)
    if selected is None:
        zero = F.lit(0).cast("bigint")
        score = sum((F.coalesce(F.col(m), zero) for m in months), zero)
        rows = rows.orderBy(score.desc_nulls_last(), *asc("serie")).limit(top_n)
    else:
        rows = rows.filter(F.col("serie").isin(list(selected)) if selected else F.lit(False))
    long = rows.unpivot("serie", months, "mes", "valor").filter(F.col("valor").isNotNull())
    ordered = long.orderBy(_month_number(F.col("mes")).asc(), *desc("valor"), *asc("serie"))
    return ordered.withColumn("mes_label", F.initcap("mes"))


def matrix_total_series(matrix: DataFrame, name: str = ALL_MODELS) -> DataFrame:
    """All rows summed per observed month."""
    months = [m for m in MONTHS if m in matrix.columns]
    sums = matrix.agg(*(F.sum(m).alias(m) for m in months)).withColumn("serie", F.lit(name))
    long = sums.unpivot("serie", months, "mes", "valor").filter(F.col("valor").isNotNull())
    return long.orderBy(_month_number(F.col("mes")).asc()).withColumn("mes_label", F.initcap("mes"))
