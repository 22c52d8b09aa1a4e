"""The codes of a fact table by period: a small table that answers text searches before the fact is opened.

A LIKE on the fact reads the code of every row. The distinct codes are few beside the rows; searched first, they turn a pattern into
a list of values, which Parquet compares with the statistics and dictionaries of its row groups, so that those without any of
the codes are skipped. The table is partitioned as the fact is, and a load refreshes the periods it replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.functions.text import like_ignore_case
from periodica.spec import DEFAULT_SPEC, SnapshotSpec, to_date

#: Codes that become a list of values; more of them are joined.
LISTED = 200


def _write(fact: DataFrame, path: str, mode: str, spec: SnapshotSpec) -> None:
    codes = fact.filter(F.col(spec.period).isNotNull()).select(spec.period, spec.model).distinct()
    laid_out = codes.hint("rebalance", spec.period).sortWithinPartitions(spec.period, spec.model)
    laid_out.write.mode("overwrite").partitionBy(spec.period).option("partitionOverwriteMode", mode).parquet(path)


def build_codes(fact: DataFrame, path: str, spec: SnapshotSpec = DEFAULT_SPEC) -> None:
    """(Re)create the codes of all periods at ``path``."""
    _write(fact, path, "static", spec)


def read_codes(spark: SparkSession, path: str, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    return spark.read.schema(f"`{spec.period}` date, `{spec.model}` string").parquet(path)


def refresh_codes(fact: DataFrame, path: str, changed: Iterable[str | date], spec: SnapshotSpec = DEFAULT_SPEC) -> None:
    """Bring the codes up to date after ``changed`` periods of ``fact`` were replaced, inserted or emptied; only these are read."""
    days = sorted({to_date(c) for c in changed})
    part = fact.filter(F.col(spec.period).isin(days))
    left = {r[0] for r in part.select(spec.period).distinct().collect()}
    if left:
        _write(part, path, "dynamic", spec)
    for day in days:
        if day not in left:
            # A partition without rows is not swapped by the job above.
            empty = fact.sparkSession.createDataFrame([], f"`{spec.model}` string")
            empty.write.mode("overwrite").parquet(f"{path}/{spec.period}={day.isoformat()}")


def rows_with_codes(
    fact: DataFrame, codes: DataFrame, pattern: str, spec: SnapshotSpec = DEFAULT_SPEC, listed: int = LISTED
) -> DataFrame:
    """The rows of ``fact`` whose code matches a case-insensitive LIKE ``pattern``, by the codes of ``read_codes``.

    Up to ``listed`` codes come to the driver and go back as a filter on the scan; beyond that the codes are joined, broadcast or
    not by their size. The rows are the same.
    """
    hits = codes.filter(like_ignore_case(F.col(spec.model), pattern)).select(spec.model).distinct()
    found = [r[0] for r in hits.limit(listed + 1).collect()]
    if len(found) > listed:
        return fact.join(hits, spec.model, "left_semi").select(fact.columns)
    return fact.filter(F.col(spec.model).isin(sorted(found)) if found else F.lit(False))
