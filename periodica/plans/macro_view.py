"""The series of the macro view, from one registrations frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from periodica.operators import macro
from periodica.spec import DEFAULT_SPEC, SnapshotSpec


@dataclass(frozen=True)
class MacroView:
    """Lazy frames of one view; all derive from the bucketed rows."""

    total: DataFrame
    by_year: DataFrame
    unattributed: DataFrame
    active_years: DataFrame
    default_years: DataFrame
    selected: DataFrame
    residuals: DataFrame


def macro_view(
    registrations: DataFrame,
    end: str | date,
    grain: str = "month",
    months: int | None = 12,
    years: Sequence[int] = (),
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> MacroView:
    rows = macro.bucketed(registrations, end, grain, months, spec)
    return MacroView(
        total=macro.total_by_bucket(rows, spec=spec),
        by_year=macro.flow_by_bucket_and_year(rows, spec),
        unattributed=macro.unattributed_by_bucket(rows, spec=spec),
        active_years=macro.active_years(rows, spec),
        default_years=macro.default_years(rows, end, spec=spec),
        selected=macro.selected_years_dense(rows, years, spec),
        residuals=macro.residual_series(rows, years, spec),
    )
