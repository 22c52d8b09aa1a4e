"""Column roles and schema of a periodic stock-snapshot table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class SnapshotSpec:
    """Names of the columns that play each role in a snapshot fact table."""

    period: str = "competencia"
    state: str = "uf"
    city: str = "municipio"
    model: str = "marca_modelo"
    year: str = "ano_fabricacao"
    measure: str = "qtd_veiculos"
    lineage: str = "filename"

    @property
    def row_columns(self) -> list[str]:
        """The six analytical columns, without the lineage column."""
        return [self.period, self.state, self.city, self.model, self.year, self.measure]

    @property
    def columns(self) -> list[str]:
        return [*self.row_columns, self.lineage]

    def schema(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField(self.period, T.DateType(), False),
                T.StructField(self.state, T.StringType()),
                T.StructField(self.city, T.StringType()),
                T.StructField(self.model, T.StringType(), False),
                T.StructField(self.year, T.IntegerType()),
                T.StructField(self.measure, T.LongType(), False),
                T.StructField(self.lineage, T.StringType()),
            ]
        )


DEFAULT_SPEC = SnapshotSpec()


def to_date(value: str | date) -> date:
    """Accept ``YYYY-MM-DD`` (longer ISO text is cut) or a ``date``."""
    if isinstance(value, date):
        return date(value.year, value.month, value.day)
    return date.fromisoformat(str(value)[:10])


def date_lit(value: str | date) -> Column:
    """A DATE literal, so that period predicates reach the scan as partition filters."""
    return F.lit(to_date(value))


def asc(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def desc(*names: str) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]
