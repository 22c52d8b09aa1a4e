"""Numeric parsing and ratios with explicit NULL handling under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from periodica.functions.text import strip

# Spark's string-to-double cast also takes type suffixes ("12d"), "NaN" and "Infinity".
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(c: Column) -> Column:
    """Plain decimal text as DOUBLE, anything else NULL."""
    text = strip(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_year(c: Column) -> Column:
    """Integral number as INT; text, fractions and out-of-range numbers are NULL."""
    number = parse_number(c)
    return F.when(number == F.floor(number), number.try_cast("int"))


def parse_quantity(c: Column) -> Column:
    """Number rounded half-even to BIGINT; anything unreadable counts 0."""
    return F.coalesce(F.bround(parse_number(c), 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` as DOUBLE, NULL when the base is zero."""
    base = F.when(whole != 0, whole).cast("double")
    return F.lit(100.0) * part.cast("double") / base


def round_binary(x: Column, digits: int = 2) -> Column:
    """Round a non-negative DOUBLE on its binary value.

    Spark's ``round`` goes through the shortest decimal text (1.005 -> 1.01); database
    engines that scale the binary value give 1.0, and published shares follow those.
    """
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
