"""The snapshot fact table: parquet partitioned by period, given by path or by catalog name."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from periodica.spec import DEFAULT_SPEC, SnapshotSpec, to_date


def _one_of(path: str | None, table: str | None) -> None:
    if (path is None) == (table is None):
        raise ValueError("give either a path or a catalog table")


def read_facts(
    spark: SparkSession, path: str | None = None, spec: SnapshotSpec = DEFAULT_SPEC, *, table: str | None = None
) -> DataFrame:
    """Scan a fact table given by path or by catalog name."""
    _one_of(path, table)
    return spark.table(table) if table else spark.read.schema(spec.schema()).parquet(path)


def _laid_out(rows: DataFrame, spec: SnapshotSpec) -> DataFrame:
    # REBALANCE groups rows by period for the directory layout, yet lets AQE split a period that
    # holds much of the data over many tasks and files. Sorting by model gives row groups narrow
    # model ranges, which the predicates on one model then skip.
    return rows.hint("rebalance", spec.period).sortWithinPartitions(spec.period, spec.model, spec.state, spec.city)


def _writer(rows: DataFrame, spec: SnapshotSpec) -> DataFrameWriter:
    """Overwrites, and keeps a Bloom filter of the codes of each row group that holds too many different ones for a dictionary.

    Row groups without a code are then skipped even where it lies between their least and greatest. The filters' size follows the codes found.
    """
    options = {f"parquet.bloom.filter.enabled#{spec.model}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    return rows.write.mode("overwrite").options(**options)


def write_facts(
    rows: DataFrame, path: str | None = None, spec: SnapshotSpec = DEFAULT_SPEC, *, table: str | None = None
) -> None:
    """(Re)create the whole table."""
    _one_of(path, table)
    writer = _writer(_laid_out(rows, spec), spec).partitionBy(spec.period)
    if table:
        writer.format("parquet").saveAsTable(table)
    else:
        writer.option("partitionOverwriteMode", "static").parquet(path)


def copy_facts(rows: DataFrame, path: str, spec: SnapshotSpec = DEFAULT_SPEC) -> None:
    """(Re)create the table at ``path`` from rows of another one, whose files are laid out already: they are neither shuffled nor sorted by model again.

    A task writes one file for each period that it reads, in the order of the files it reads.
    """
    writer = _writer(rows, spec).partitionBy(spec.period)
    writer.option("partitionOverwriteMode", "static").parquet(path)


def _checked(rows: DataFrame, days: Sequence[date], spec: SnapshotSpec) -> DataFrame:
    """The columns of a fact that ``rows`` have; a row of a period that is not among ``days`` fails the job that writes it."""
    found = F.col(spec.period).cast("date")
    wanted = ", ".join(str(d) for d in days)
    message = F.concat(F.lit(f"a row of {spec.period} "), F.coalesce(found.cast("string"), F.lit("NULL")), F.lit(f" in a load of {wanted}"))
    inside = F.coalesce(found.isin(list(days)), F.lit(False)) if days else F.lit(False)
    checked = F.when(inside, found).otherwise(F.raise_error(message).cast("date"))
    return rows.select([c for c in spec.columns if c in rows.columns]).withColumn(spec.period, checked)


def replace_periods(
    rows: DataFrame, path: str | None, periods: Iterable[str | date], spec: SnapshotSpec = DEFAULT_SPEC, *, table: str | None = None
) -> None:
    """Replace several periods by ``rows`` in one job; running it again gives the same table.

    A row of a period that is not named fails the job, and a failed job leaves all periods as they were: their partitions
    are swapped together when it commits. Named periods without rows are emptied after that.
    """
    _one_of(path, table)
    spark = rows.sparkSession
    days = sorted({to_date(p) for p in periods})
    months = _checked(rows, days, spec)
    if table:
        own = [c for c in spark.table(table).columns if c != spec.period]
        values = [F.col(c) if c in months.columns else F.lit(None).alias(c) for c in own]
        # Without this mode the insertion would empty the whole table first.
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")
        try:
            _laid_out(months.select(*values, spec.period), spec).write.mode("overwrite").insertInto(table)
        finally:
            spark.conf.set(mode, before)
    else:
        writer = _writer(_laid_out(months, spec), spec).partitionBy(spec.period)
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    # The job swaps the partitions that have rows; which ones is told by the period column alone.
    loaded = {r[0] for r in rows.select(F.col(spec.period).cast("date")).distinct().collect()}
    for day in days:
        if day not in loaded:
            replace_period(rows.filter(F.lit(False)), path, day, spec, table=table)


def replace_period(
    rows: DataFrame,
    path: str | None,
    period: str | date,
    spec: SnapshotSpec = DEFAULT_SPEC,
    *,
    table: str | None = None,
    probe: DataFrame | None = None,
) -> None:
    """Replace one period by ``rows``; running it again gives the same table.

    A row of another period fails the write, as the rows are written. The partition is swapped when the
    job commits, so a failed attempt leaves the old month in place and other months are never touched.
    Without rows the month is emptied. ``probe`` is a cheaper frame that is empty exactly when ``rows``
    is, such as the input of an aggregation; a catalog table needs none.
    """
    _one_of(path, table)
    day = to_date(period)
    month = _checked(rows, [day], spec)
    if table:
        # One static partition: it is replaced whole, also by nothing. The check stays in the rows that are inserted.
        own = [c for c in rows.sparkSession.table(table).columns if c != spec.period]
        values = [F.col(c) if c in month.columns else F.lit(None).alias(c) for c in own]
        guarded = month.filter(F.col(spec.period).isNotNull()).select(values)
        rows.sparkSession.sql(
            f"INSERT OVERWRITE TABLE {table} PARTITION ({spec.period} = DATE '{day.isoformat()}') SELECT * FROM {{rows}}",
            rows=guarded.hint("rebalance").sortWithinPartitions(spec.model, spec.state, spec.city),
        )
    elif (rows if probe is None else probe).isEmpty():
        month.drop(spec.period).write.mode("overwrite").parquet(f"{path}/{spec.period}={day.isoformat()}")
    else:
        writer = _writer(_laid_out(month, spec), spec).partitionBy(spec.period)
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
