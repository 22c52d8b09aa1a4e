"""Period labels and month / quarter / semester buckets."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from periodica.spec import to_date

# Month abbreviations used as matrix columns and in labels.
MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]

GRAINS = ("month", "quarter", "semester")


def _first_month_of_semester(c: Column) -> Column:
    return F.when(F.month(c) <= 6, F.lit(1)).otherwise(F.lit(7))


def bucket_start(c: Column, grain: str) -> Column:
    """First day of the bucket; a monthly bucket is the period itself."""
    if grain == "month":
        return c
    if grain == "quarter":
        return F.trunc(c, "QUARTER")
    if grain == "semester":
        return F.make_date(F.year(c), _first_month_of_semester(c), F.lit(1))
    raise ValueError(f"unknown grain {grain!r}, expected one of {GRAINS}")


def bucket_label(c: Column, grain: str) -> Column:
    """``Apr/26``, ``2026T2`` or ``S1/2026``."""
    year = F.year(c).cast("string")
    if grain == "month":
        return F.date_format(c, "MMM/yy")
    if grain == "quarter":
        return F.concat(year, F.lit("T"), F.quarter(c).cast("string"))
    if grain == "semester":
        half = F.when(F.month(c) <= 6, F.lit("S1/")).otherwise(F.lit("S2/"))
        return F.concat(half, year)
    raise ValueError(f"unknown grain {grain!r}, expected one of {GRAINS}")


def month_label(c: Column) -> Column:
    """``abr/26``."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.concat(F.element_at(names, F.month(c)), F.lit("/"), F.date_format(c, "yy"))


def first_trailing_month(end: str | date, months: int | None) -> date | None:
    """The day from which ``within_trailing_months`` keeps periods; ``None`` means from the beginning."""
    last = to_date(end)
    if months is None:
        return None
    year, month = divmod(last.year * 12 + last.month - months, 12)
    days = (date(year + month // 11, (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(year, month + 1, min(last.day, days))


def within_trailing_months(c: Column, end: str | date, months: int | None) -> Column:
    """Periods of the last ``months`` months up to ``end``; ``None`` means all up to ``end``."""
    last = F.lit(to_date(end))
    if months is None:
        return c <= last
    return c.between(F.add_months(last, 1 - months), last)
