"""What the operators of this subpackage share: tables, the shared folder, per-row Python passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Upper-case A-Z to lower case, every other byte as it is. The letters beyond ASCII keep their case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def cut(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as Parquet to the shared folder and read again: a lost executor repeats nothing."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def per_row(
    frame: DataFrame,
    inputs: list[str],
    fields: list[tuple[str, str]],
    make: Callable[[], Callable],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``frame`` with columns computed by Python from ``inputs``, one Arrow batch at a time.

    ``make()`` runs once a task and gives a function from lists of values to lists of results, one
    list for each of ``fields``, pairs of name and Spark type. A column of such a name, in any case, is replaced, and
    those of ``drop`` are read but not returned.
    """
    names = [n for n, _ in fields]
    taken = {n.lower() for n in names}
    # Columns go by position, so that their names may hold dots or differ by case only.
    kept = [i for i, c in enumerate(frame.columns) if c.lower() not in taken or c in inputs]
    passed = [i for i in kept if frame.columns[i].lower() not in taken and frame.columns[i] not in drop]
    schema = T.StructType(
        [frame.schema[i] for i in passed] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]
    )
    arrow = to_arrow_schema(schema)
    read = [kept.index(frame.columns.index(c)) for c in inputs]
    copied = [kept.index(i) for i in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            results = function(*(batch.column(i).to_pylist() for i in read))
            columns = [batch.column(i).cast(arrow.field(at).type) for at, i in enumerate(copied)]
            columns += [pa.array(r, arrow.field(at).type) for at, r in enumerate(results, len(copied))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    placed = frame.toDF(*(f"_{i}" for i in range(len(frame.columns))))
    return placed.select(*(f"_{i}" for i in kept)).mapInArrow(run, schema)


def text_of(column: str = "text") -> F.Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


