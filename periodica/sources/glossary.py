"""Glossary of friendly names: one row per model code."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODE = "codigo_modelo"
NAME = "nome_amigavel"
_SCHEMA = f"{CODE} string, {NAME} string"


def empty_glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _SCHEMA)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Read the CSV; NULL and missing columns become ``""``, a missing file gives no rows."""
    try:
        raw = spark.read.option("header", True).option("escape", '"').csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_glossary(spark)
    return raw.select(
        [
            (F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("")).alias(c)
            for c in (CODE, NAME)
        ]
    )
