"""Registry files of several headers, with malformed records set aside instead of failing the load.

``read_registry`` is strict: one header for all files, and the first malformed record ends the job. A load of thousands of files needs
the other way: files are read by distinct header, each set of columns is made canonical and the rows are united; a
record with more or fewer fields than its file's header keeps its file, its line number and its text, and goes to a quarantine
folder; a stated limit on their number fails the load before anything is replaced.

Headers are the first lines of the files, looked at by the driver as it lists them: one short read for each file and no pass over the
text. All else is Spark's: lines are read as text (so that they are numbered and kept as they stood), decoded and parsed by column.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.sources.registry import canonical_columns, require_columns
from periodica.spec import DEFAULT_SPEC, SnapshotSpec

REJECTED = "_rejeitada"
#: Where a malformed record stands, its text and what is wrong with it; NULL of a well-formed one.
DETAIL = "_detalhe"
_RECORD, _BAD, _REASON = "_registro", "_malformado", "_motivo"
_FILE, _BLOCK, _ID = "_arquivo", "_bloco", "_numero"
_CUT, _CSV = "_partes", "_csv"
_END = "\u0002"


class TooManyRejected(ValueError):
    """More malformed records than the load allows."""


@dataclass(frozen=True)
class RegistryFiles:
    """Files of one or more headers: ``rows`` with canonical columns, the mark ``REJECTED`` and its ``DETAIL``, ``lines`` as they stand."""

    detailed: DataFrame
    lines: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.detailed.drop(DETAIL)

    @property
    def accepted(self) -> DataFrame:
        """Canonical text columns and lineage of the well-formed records."""
        return self.rows.filter(~F.col(REJECTED)).drop(REJECTED)

    def rejected(self) -> DataFrame:
        """``arquivo``, ``linha`` (from 1, the header's), ``registro`` (its text) and ``motivo`` of the malformed records.

        A record's line is its place in its block of the file plus the lines of the blocks before. Both come from one listing of the
        files, so that the numbers given to lines are the same.
        """
        return self.placed(self.detailed.filter(F.col(REJECTED)).select(DETAIL))

    def placed(self, bad: DataFrame) -> DataFrame:
        """``rejected`` of the ``DETAIL`` of the malformed records, which a job that read the rows may have kept: their text is not parsed again."""
        bad = bad.select(f"{DETAIL}.*")
        blocks = self.lines.groupBy(_FILE, _BLOCK).agg(F.min(_ID).alias("_primeiro"), F.count(F.lit(1)).alias("_linhas"))
        above = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        begins = F.coalesce(F.sum("_linhas").over(above), F.lit(0)) - F.col("_primeiro")
        # One row per block of a file: malformed records, which may be many, stay where they are.
        placed = bad.join(F.broadcast(blocks.select(_FILE, _BLOCK, begins.alias("_antes"))), [_FILE, _BLOCK])
        return placed.select(
            F.col(_FILE).alias("arquivo"),
            (F.col("_antes") + F.col(_ID) + 1).alias("linha"),
            F.col(_RECORD).alias("registro"),
            F.col(_REASON).alias("motivo"),
        )


def _paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files under ``paths``, as Spark lists them."""
    jvm = spark._jvm
    found = spark.read.text(paths).inputFiles()
    return sorted(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in found)


def first_lines(spark: SparkSession, files: Sequence[str], encoding: str) -> dict[str, str]:
    """The first line of each file ('' of an empty one), through the file system that Spark reads it by."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found = {}
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(conf).open(path)
        codec = codecs.getCodec(path)
        reader = jvm.java.io.BufferedReader(
            jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, encoding)
        )
        try:
            found[file] = reader.readLine() or ""
        finally:
            reader.close()
    return found


def _lines(spark: SparkSession, files: Sequence[str], encoding: str) -> DataFrame:
    """Decoded lines with file, block and a number that grows within a block."""
    text = spark.read.text(list(files)).select(
        F.col("value"),
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_ID),
    )
    return text.withColumn(_RECORD, F.decode(F.col("value").cast("binary"), encoding)).drop("value")


def _parsed(lines: DataFrame, header: str, count: int, sep: str) -> DataFrame:
    """The records of files that begin with ``header``, of ``count`` fields; a header line is none, nor is an empty one."""
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_texto"}

    schema = ", ".join([*(f"_c{i} string" for i in range(count)), "_texto string"])
    names = [f"_c{i}" for i in range(count)]
    body = lines.filter((F.col(_RECORD) != F.lit(header)) & (F.trim(_RECORD) != ""))
    # A record without quotes, as most are, is no more than its text between separators; the CSV parser takes several times as long. It is
    # asked for the others, and for a mark of comments, which is NUL unless another is set.
    plain = ~F.col(_RECORD).contains('"') & ~F.col(_RECORD).startswith("\0")
    cut = F.when(plain, F.split(_RECORD, re.escape(sep), -1)).alias(_CUT)
    parsed = F.when(~plain, F.from_csv(_RECORD, schema, options)).alias(_CSV)
    # Out of an array of one, so that filters on fields stay above: moved below, each would parse the record again.
    read = body.select(_FILE, _BLOCK, _ID, _RECORD, F.inline(F.array(F.struct(cut, parsed))))
    simple = F.col(_CUT).isNotNull()
    bad = F.when(simple, F.size(_CUT) != count).otherwise(F.col(f"{_CSV}._texto").isNotNull())
    values = [F.when(simple, F.nullif(F.get(_CUT, F.lit(i)), F.lit(""))).otherwise(F.col(f"{_CSV}.{n}")).alias(n) for i, n in enumerate(names)]
    # Asked of malformed records only: a field put behind a record that is too short comes to stand among the header's. They are looked at as
    # one text, because a function of each field would keep the whole job from being compiled.
    longer = F.from_csv(F.concat(F.col(_RECORD), F.lit(sep + _END)), schema.removesuffix(", _texto string"), options)
    added = longer.cast("string").rlike(r"(^\{|, )" + _END)
    short = F.when(simple, F.size(_CUT) < count).otherwise(added)
    reason = F.when(bad, F.when(short, "campos de menos").otherwise("campos demais"))
    return read.select(_FILE, _BLOCK, _ID, _RECORD, bad.alias(_BAD), reason.alias(_REASON), *values)


def read_registry_files(
    spark: SparkSession, path: str | Sequence[str], *, sep: str = ";", encoding: str = "ISO-8859-1", spec: SnapshotSpec = DEFAULT_SPEC
) -> RegistryFiles:
    """Registry files whatever their headers, as long as each header has the required columns.

    Columns that only some headers have are NULL in the rows of the others. A header without a required column, or a file
    without any line, fails here.
    """
    headers: dict[str, list[str]] = {}
    files = _paths(spark, [path] if isinstance(path, str) else list(path))
    for file, line in first_lines(spark, files, encoding).items():
        headers.setdefault(line, []).append(file)
    united, lines = [], []
    for header, members in sorted(headers.items()):
        columns = next(csv.reader([header], delimiter=sep), [])
        names = canonical_columns(columns, spec)
        require_columns(names, columns, spec)
        own = _lines(spark, members, encoding)
        records = _parsed(own, header, len(columns), sep)
        bad = F.col(_BAD)
        values = [F.when(~bad, F.col(f"_c{i}")).alias(names.get(c, c)) for i, c in enumerate(columns)]
        detail = F.when(bad, F.struct(_FILE, _BLOCK, _ID, _RECORD, _REASON)).alias(DETAIL)
        united.append(records.select(*values, F.col(_FILE).alias(spec.lineage), bad.alias(REJECTED), detail))
        lines.append(own)

    def union(frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    return RegistryFiles(union(united), union(lines))


def set_aside(files: Sequence[RegistryFiles], found: int, folder: str, limit: int, kept: Sequence[DataFrame] | None = None) -> None:
    """Write the ``found`` malformed records of ``files`` to ``folder`` and fail if they are more than ``limit``.

    ``kept`` has the ``DETAIL`` of those of each of ``files``, if a job has written it.
    """
    if found:
        placed = (f.rejected() for f in files) if kept is None else (f.placed(bad) for f, bad in zip(files, kept, strict=True))
        reduce(DataFrame.unionByName, placed).write.mode("overwrite").parquet(folder)
    if found > limit:
        raise TooManyRejected(f"{found} malformed records, {limit} allowed; see {folder}")
