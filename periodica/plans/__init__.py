"""Jobs composed of operators."""

from periodica.plans.kept_pairs import build_pairs, read_pairs, refresh_pairs, stale_periods
from periodica.plans.macro_view import MacroView, macro_view
from periodica.plans.monthly_load import StagedLoad, load_month, load_months, load_staged_month, load_staged_months, stage_months

__all__ = [
    "MacroView",
    "StagedLoad",
    "build_pairs",
    "load_month",
    "load_months",
    "load_staged_month",
    "load_staged_months",
    "macro_view",
    "read_pairs",
    "refresh_pairs",
    "stage_months",
    "stale_periods",
]
