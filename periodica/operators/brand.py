"""One-period report of a brand. ``snapshot`` holds the rows of the period to report on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.functions.frames import sort_bounded
from periodica.functions.text import is_no_information
from periodica.operators.enrich import classify_by_text, family_mix, friendly_name
from periodica.operators.stock import stock_by
from periodica.presets import BRAND_B, Brand
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, asc, desc

NAME = "friendly_name"
NO_YEAR = "Sem MY"


def label_models(
    rows: DataFrame, brand: Brand = BRAND_B, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Friendly name and family; both depend on the code only, so label aggregated rows."""
    model = F.col(spec.model)
    return rows.withColumns(
        {
            NAME: friendly_name(model, brand.names),
            "family": classify_by_text(model, brand.families, brand.default_family),
        }
    )


def _year_label(spec: SnapshotSpec) -> Column:
    return F.coalesce(F.col(spec.year).cast("string"), F.lit(NO_YEAR))


def _pending(spec: SnapshotSpec) -> Column:
    return F.col(spec.year).isNull() & is_no_information(F.col(spec.city), accent_sensitive=False)


def _limited(frame: DataFrame, limit: int | None) -> DataFrame:
    return frame if limit is None else frame.limit(limit)


def brand_kpis(
    snapshot: DataFrame, brand: Brand = BRAND_B, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Total, distinct models, leading model, leading model year (unknown counts as one), pending.

    One scan: sums per (model, year) are summed up by grouping sets, and the leaders are the smallest
    of structs that spell out their order.
    """
    units = F.col(spec.measure)
    base = snapshot.groupBy(spec.model, spec.year).agg(
        F.sum(units).alias("total"), F.sum(F.when(_pending(spec), units)).alias("pendente")
    )
    model, year = F.col(spec.model), F.col(spec.year)
    sets = base.groupingSets([[model], [year], []], model, year).agg(
        F.grouping_id().alias("conjunto"), F.sum("total").alias("total"), F.sum("pendente").alias("pendente")
    )
    of_model, of_year, of_all = (F.col("conjunto") == i for i in (1, 2, 3))

    def first(condition: Column, *order: Column) -> Column:
        """Smallest by ``order``, NULL last in each place."""
        parts = [p for o in order for p in (o.isNull(), o)]
        return F.min(F.when(condition, F.struct(*(p.alias(f"o{i}") for i, p in enumerate(parts)))))

    figures = label_models(sets, brand, spec).agg(
        F.max(F.when(of_all, F.col("total"))).alias("total"),
        F.coalesce(F.max(F.when(of_all, F.col("pendente"))), F.lit(0).cast("bigint")).alias("pendente"),
        F.count(F.when(of_model, model)).alias("modelos"),
        first(of_model, -F.col("total"), F.col(NAME), model).alias("modelo"),
        first(of_year, -F.col("total"), -year).alias("ano"),
    )
    year_label = F.coalesce((-F.col("ano.o3")).cast("string"), F.lit(NO_YEAR))
    return figures.select(
        "total",
        "modelos",
        F.col("modelo.o3").alias("modelo_lider"),
        (-F.col("modelo.o1")).alias("modelo_lider_total"),
        F.when(F.col("ano").isNotNull(), year_label).alias("my_lider"),
        (-F.col("ano.o1")).alias("my_lider_total"),
        "pendente",
    )


def brand_models(
    snapshot: DataFrame,
    brand: Brand = BRAND_B,
    limit: int | None = None,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Models by stock, then name."""
    stock = label_models(stock_by(snapshot, spec.model, spec=spec, name=spec.measure), brand, spec)
    ordered = stock.select(spec.model, NAME, spec.measure).orderBy(
        *desc(spec.measure), *asc(NAME, spec.model)
    )
    return _limited(ordered, limit)


def brand_family_mix(
    snapshot: DataFrame, brand: Brand = BRAND_B, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Units and percentage per family."""
    stock = label_models(stock_by(snapshot, spec.model, spec=spec, name=spec.measure), brand, spec)
    return family_mix(stock, core=(), units=spec.measure).drop("lider")


def brand_by_state(
    snapshot: DataFrame, limit: int | None = 12, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    stock = stock_by(snapshot, spec.state, spec=spec, name=spec.measure)
    return _limited(stock.orderBy(*desc(spec.measure), *asc(spec.state)), limit)


def brand_by_city(
    snapshot: DataFrame, limit: int | None = 15, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    stock = stock_by(snapshot, spec.city, spec.state, spec=spec, name=spec.measure)
    return _limited(stock.orderBy(*desc(spec.measure), *asc(spec.city, spec.state)), limit)


def _of_models(snapshot: DataFrame, models: Sequence[str] | None, spec: SnapshotSpec) -> DataFrame:
    return snapshot.filter(F.col(spec.model).isin(list(models))) if models else snapshot


def brand_city_list(
    snapshot: DataFrame, models: Sequence[str] | None = None, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Stock by city, for all models or the chosen ones."""
    rows = _of_models(snapshot, models, spec)
    stock = stock_by(rows, spec.state, spec.city, spec=spec, name=spec.measure)
    label = F.concat(F.col(spec.city), F.lit(" / "), F.col(spec.state))
    return stock.withColumn("territorio", label).orderBy(
        *desc(spec.measure), *asc(spec.city, spec.state)
    )


def brand_city_detail(
    snapshot: DataFrame,
    state: str,
    city: str,
    models: Sequence[str] | None = None,
    brand: Brand = BRAND_B,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Models and model years of one city; the unknown year keeps its row."""
    rows = _of_models(snapshot, models, spec).filter(
        (F.col(spec.state) == state) & (F.col(spec.city) == city)
    )
    stock = label_models(stock_by(rows, spec.model, spec.year, spec=spec, name=spec.measure), brand, spec)
    labelled = stock.withColumn(spec.year, _year_label(spec))
    return labelled.select(spec.model, NAME, "family", spec.year, spec.measure).orderBy(
        *desc(spec.measure), *asc(NAME, spec.model, spec.year)
    )


def brand_city_names(
    detail: DataFrame, limit: int = 12, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Largest friendly names of a city detail."""
    sums = detail.groupBy(NAME).agg(F.sum(spec.measure).alias(spec.measure))
    return sums.orderBy(*desc(spec.measure), *asc(NAME)).limit(limit)


def brand_model_options(
    snapshot: DataFrame,
    limit: int | None = 8,
    brand: Brand = BRAND_B,
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Distinct models by name; the first ones are the default choice."""
    models = label_models(snapshot.select(spec.model).distinct(), brand, spec)
    return _limited(models.select(spec.model, NAME).orderBy(*asc(NAME, spec.model)), limit)


def brand_by_year(snapshot: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Stock by model year, the unknown one included."""
    stock = stock_by(snapshot, spec.year, spec=spec, name=spec.measure)
    ordered = sort_bounded(stock, *desc(spec.measure), *desc(spec.year))
    return ordered.withColumn(spec.year, _year_label(spec))


def brand_pending_models(
    snapshot: DataFrame, brand: Brand = BRAND_B, spec: SnapshotSpec = DEFAULT_SPEC
) -> DataFrame:
    """Models of unknown year in the no-information bucket."""
    stock = stock_by(snapshot.filter(_pending(spec)), spec.model, spec=spec, name=spec.measure)
    return label_models(stock, brand, spec).select(spec.model, NAME, spec.measure).orderBy(
        *desc(spec.measure), *asc(NAME, spec.model)
    )
