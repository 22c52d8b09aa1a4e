"""Helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def gather(frame: DataFrame) -> DataFrame:
    """One partition, so that windows and sorts that follow need no further shuffle.

    Only for aggregates that the calendar bounds: one row per period, per model year, or per
    (period, model year), however large the table is.
    """
    return frame.repartition(1)


def sort_bounded(frame: DataFrame, *order: Column) -> DataFrame:
    """Total order of such an aggregate without the sampling job of a range partitioning."""
    return gather(frame).orderBy(*order)
