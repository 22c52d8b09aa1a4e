"""Registry text files: ``;``-separated, latin-1, header, every column text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.functions.text import plain_text
from periodica.spec import DEFAULT_SPEC, SnapshotSpec


def read_registry(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    sep: str = ";",
    encoding: str = "ISO-8859-1",
    spec: SnapshotSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Scan registry files as text columns plus the file each row came from.

    Lines are the split boundary (no multi-line records), so one large file is read in parallel. Nothing is
    moved or dropped silently: a file whose header differs from the first one's fails the read, and so does a record
    with more or fewer fields than the header, for which whole records are parsed whatever columns are asked for.
    """
    raw = (
        spark.read.option("sep", sep)
        .option("encoding", encoding)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .csv(path if isinstance(path, str) else list(path))
    )
    return raw.withColumn(spec.lineage, F.col("_metadata.file_path"))


def _role(header: str, spec: SnapshotSpec) -> str | None:
    lowered = header.strip().lower()
    plain = " ".join(plain_text(header).upper().split())
    if plain == "UF":
        return spec.state
    # Fragments that identify a column, in the order in which they are tried.
    fragments = [
        ("municip", "MUNIC", spec.city),
        ("marca modelo", "MARCA MODELO", spec.model),
        ("ano fabrica", "ANO FABRICA", spec.year),
    ]
    for raw_fragment, plain_fragment, role in fragments:
        if raw_fragment in lowered or plain_fragment in plain:
            return role
    return spec.measure if "qtd" in lowered else None


def canonical_columns(columns: Sequence[str], spec: SnapshotSpec = DEFAULT_SPEC) -> dict[str, str]:
    """Header name -> canonical name, for the headers that are recognised."""
    mapping: dict[str, str] = {}
    for column in columns:
        role = _role(column, spec)
        if role is None:
            continue
        if role in mapping.values():
            first = next(c for c, r in mapping.items() if r == role)
            raise ValueError(f"headers {first!r} and {column!r} both match {role!r}")
        mapping[column] = role
    return mapping


def require_columns(mapping: dict[str, str], columns: Sequence[str], spec: SnapshotSpec = DEFAULT_SPEC) -> None:
    """Fail if ``mapping``, that of the header ``columns``, lacks a column that a load needs."""
    required = [spec.state, spec.city, spec.model, spec.year, spec.measure]
    missing = [c for c in required if c not in mapping.values()]
    if missing:
        raise ValueError(f"no header matches {missing}; found {list(columns)}")


def canonicalize(raw: DataFrame, spec: SnapshotSpec = DEFAULT_SPEC) -> DataFrame:
    """Rename recognised headers; other columns stay as they are."""
    mapping = canonical_columns(raw.columns, spec)
    require_columns(mapping, raw.columns, spec)
    return raw.select([F.col("`" + c.replace("`", "``") + "`").alias(mapping.get(c, c)) for c in raw.columns])
