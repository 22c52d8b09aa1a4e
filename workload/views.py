"""Domain views derived from the test tables.

``*_SQL`` texts run unchanged on Spark and DuckDB; table names are ``{placeholders}``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.plans.kept_pairs import build_pairs, read_pairs, refresh_pairs
from periodica.plans.monthly_load import load_staged_month, load_staged_months, stage_months
from periodica.presets import BRAND_A
from periodica.session import release_shuffles, shared_folder
from periodica.sources.dictionary import build_codes, read_codes, refresh_codes
from periodica.sources.facts import copy_facts, read_facts, replace_period, write_facts
from periodica.sources.glossary import read_glossary
from periodica.sources.quarantine import RegistryFiles, read_registry_files
from periodica.sources.registry import read_registry
from periodica.spec import DEFAULT_SPEC
from workload import params as p

CODE_SQL = """concat(CASE (p_partkey*7) % 5 WHEN 0 THEN 'H-D/' WHEN 1 THEN 'I/H.DAVIDSON '
        WHEN 2 THEN 'IMP/H.DAVIDSON ' WHEN 3 THEN 'HARLEY DAVIDSON/' ELSE 'H.DAVIDSON/' END,
   CAST(p_partkey AS STRING), ' ',
   CASE p_partkey % 24 WHEN 0 THEN 'FLHX' WHEN 1 THEN 'FLHXSE' WHEN 2 THEN 'FLTRX' WHEN 3 THEN 'FLFB'
        WHEN 4 THEN 'FLHC' WHEN 5 THEN 'FXBB' WHEN 6 THEN 'FXLRS' WHEN 7 THEN 'RA1250S' WHEN 8 THEN 'RH975S'
        WHEN 9 THEN 'XL1200X' WHEN 10 THEN 'XL883N' WHEN 11 THEN 'VRSCF' WHEN 12 THEN 'FXDL' WHEN 13 THEN 'FXDC'
        WHEN 14 THEN 'XG750' WHEN 15 THEN 'FLHTCUTG' WHEN 16 THEN 'WLA' WHEN 17 THEN 'FLD' WHEN 18 THEN 'FLHXL'
        WHEN 19 THEN 'FXSB' WHEN 20 THEN 'XR1200X' WHEN 21 THEN 'FLHTK' WHEN 22 THEN 'FLSTN' ELSE 'TOPPER' END)"""

FLEET_SQL = f"""
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS competencia, n_name AS uf,
 CASE WHEN l_returnflag='R' AND l_linenumber<=3 THEN ' Sem Informação ' ELSE s_name END AS municipio,
 {CODE_SQL} AS marca_modelo,
 CASE WHEN l_linenumber=7 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS ano_fabricacao,
 CAST(SUM(CAST(l_quantity AS INT)) AS BIGINT) AS qtd_veiculos
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey=o_orderkey JOIN {{part}} ON l_partkey=p_partkey
 JOIN {{supplier}} ON l_suppkey=s_suppkey JOIN {{nation}} ON s_nationkey=n_nationkey
GROUP BY 1,2,3,4,5"""

# Codes of the last kind are unknown to the glossary; most of the others have a blank name.
GLOSSARY_SQL = f"""
SELECT codigo_modelo,
 CASE WHEN codigo_modelo LIKE '% FLHX' THEN 'Street Glide'
      WHEN codigo_modelo LIKE '% FLHXSE' THEN 'CVO Street Glide'
      WHEN codigo_modelo LIKE '% FLFB' THEN 'Fat Boy' ELSE '' END AS nome_amigavel
FROM (SELECT {CODE_SQL} AS codigo_modelo FROM {{part}})
WHERE codigo_modelo NOT LIKE '% TOPPER'"""

# Codes in the registry text that are of the second brand, or nearly so; one is picked by the row's numbers.
REGISTRY_CODES = (
    "I/INDIAN SCOUT",
    " Índian/chief  Vintage",
    "INDIANA/JONES",
    "INDIAN",
    "indian-pursuit",
    "IMP/INDIAN FTR",
    "I/INDIAN/CHIEF",
    "imp/índian",
    "INDIAN CHIEFTAIN",
    "I/INDIAN-ROADMASTER",
    "IMP/INDIANA",
    "I/INDIANO SCOUT",
    "X/INDIAN SCOUT",
    "I /INDIAN SCOUT",
    "INDIAN_SCOUT",
    "IMP INDIAN SCOUT",
    "INDIANAPOLIS",
    "I/ INDIAN SCOUT",
    "INDIAN.SCOUT",
    "MINDIAN/SCOUT",
    "INDIAN/SPRINGFIELD",
    "I/INDIAN FTR 1200",
)

# Every fleet row as registry text, with the defects an ingest has to deal with.
RAW_SQL = f"""
SELECT concat(' ', uf) AS uf_texto,
 CASE n % 6 WHEN 1 THEN concat(municipio, '  São João d''Água ') WHEN 2 THEN NULL ELSE municipio END AS municipio_texto,
 CASE n % 11 WHEN 1 THEN lower(marca_modelo) WHEN 2 THEN concat('  ', marca_modelo, ' ')
   WHEN 3 THEN replace(marca_modelo, 'A', 'Á') WHEN 4 THEN concat('FORD/', marca_modelo)
   WHEN 5 THEN 'I/H. Davidson  FXR' WHEN 6 THEN 'HARLEYDAVIDSON/FLHTCI'
   WHEN 7 THEN split_part('{"|".join(REGISTRY_CODES)}', '|', CAST((n + qtd_veiculos) % {len(REGISTRY_CODES)} AS INT) + 1)
   ELSE marca_modelo END AS marca_texto,
 CASE n % 7 WHEN 1 THEN 's/ano' WHEN 2 THEN CAST(ano_fabricacao AS STRING) || '.0' WHEN 3 THEN '1999.5'
   ELSE CAST(ano_fabricacao AS STRING) END AS ano_texto,
 CASE n % 9 WHEN 1 THEN 'x' WHEN 2 THEN '12d' WHEN 3 THEN '2.5' WHEN 4 THEN '3.5' WHEN 5 THEN NULL
   WHEN 6 THEN concat(' ', CAST(qtd_veiculos AS STRING), ' ') WHEN 7 THEN '1e1'
   ELSE CAST(qtd_veiculos AS STRING) END AS qtd_texto
FROM (SELECT *, CAST(regexp_extract(marca_modelo, '([0-9]+) ', 1) AS INT) AS n FROM {{fleet}})"""

# Columns of registry files of two headers, by column of RAW_SQL; the second one has a column of its own.
LAYOUTS = (
    {"uf_texto": "UF", "municipio_texto": "Município", "marca_texto": "Marca Modelo", "ano_texto": "Ano Fabricação", "qtd_texto": "Qtd. Veículos"},
    {"qtd_texto": "QTD_VEICULOS", "marca_texto": "MARCA MODELO", "uf_texto": "UF", "ano_texto": "Ano Fabricacao", "municipio_texto": "Municipio", "'b'": "Origem"},
)


def _line(columns: list[str]) -> str:
    return "concat(" + ", ';', ".join(f"coalesce({c}, '')" for c in columns) + ")"


# The same rows as lines of text, by layout: rows of some codes have a field too many or lack the last one.
LINES_SQL = f"""
SELECT layout, defeito, CASE defeito WHEN 'campos demais' THEN concat(inteira, ';sobra') WHEN 'campos de menos' THEN curta ELSE inteira END AS linha, *
FROM (SELECT *, CASE layout WHEN 0 THEN {_line(list(LAYOUTS[0]))} ELSE {_line(list(LAYOUTS[1]))} END AS inteira,
  CASE layout WHEN 0 THEN {_line(list(LAYOUTS[0])[:-1])} ELSE {_line(list(LAYOUTS[1])[:-1])} END AS curta
 FROM (SELECT *, m % 2 AS layout, CASE m % 13 WHEN 3 THEN 'campos demais' WHEN 5 THEN 'campos de menos' ELSE '' END AS defeito
  FROM (SELECT *, length(concat(coalesce(marca_texto, ''), coalesce(qtd_texto, ''), coalesce(municipio_texto, ''), coalesce(ano_texto, ''))) AS m FROM ({RAW_SQL}))))"""

# Codes of the second brand. The last two are completed by the row's number.
BRAND_B_CODES = (
    "INDIAN/SCOUT",
    "I/INDIAN SCOUT",
    "I/INDIAN SCOUT BOBBER",
    "INDIAN/CHIEF VINTAGE",
    "I/INDIAN CHIEF VINTAGE",
    "INDIAN/CHIEF CLASSIC",
    "INDIAN/CHIEF SPRINGFIELD",
    "I/INDIAN CHIEF SPRINGFLD",
    "INDIAN/CHIEF ROADMASTER",
    "I/INDIAN CHIEF ROADMASTR",
    "INDIAN/CHIEF CHIEFTAIN",
    "I/INDIAN CHIEF CHIEFTAIN",
    "I/INDIAN CHIEF CHIEFT DH",
    "I/INDIAN CHIEF DARKHORSE",
    "I/INDIAN CHIEF",
    "IMP/INDIAN",
    "I/INDIAN BOARD TRACK RAC",
    "I/INDIAN VINTAGE LE",
    " i/índian  scout",
    "INDIAN/FTR 1200",
    "INDIAN-PURSUIT",
    "INDIAN/",
    "I/INDIAN CHIEF ",
)
# Every fleet row under one of these codes, as one period.
BRAND_B_SQL = f"""
SELECT CAST('2026-04-01' AS DATE) AS competencia, uf, municipio,
 concat(split_part('{"|".join(BRAND_B_CODES)}', '|', n % 23 + 1), CASE WHEN n % 23 > 20 THEN CAST(n AS STRING) ELSE '' END) AS marca_modelo,
 CASE WHEN n % 5 = 0 THEN NULL ELSE ano_fabricacao END AS ano_fabricacao, qtd_veiculos
FROM (SELECT *, CAST(regexp_extract(marca_modelo, '([0-9]+) ', 1) AS INT) AS n FROM {{fleet}})"""

FLEET_TABLES = ("lineitem", "orders", "part", "supplier", "nation")

_frames: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The rows of FLEET_SQL for Spark: columns are narrowed before the first shuffle, and a code, which tells its part's key, is spelled after the last sum.
FLEET_NARROW_SQL = f"""
SELECT competencia, uf, municipio, {CODE_SQL} AS marca_modelo, ano_fabricacao, qtd_veiculos
FROM (
 SELECT l_mes AS competencia, n_name AS uf, CASE WHEN l_sem_local THEN ' Sem Informação ' ELSE s_name END AS municipio, p_partkey,
  CASE WHEN l_sem_ano THEN NULL ELSE o_ano END AS ano_fabricacao, CAST(SUM(l_unidades) AS BIGINT) AS qtd_veiculos
 FROM (SELECT l_orderkey, l_partkey, l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS l_mes, CAST(l_quantity AS INT) AS l_unidades,
   l_returnflag='R' AND l_linenumber<=3 AS l_sem_local, l_linenumber=7 AS l_sem_ano FROM {{lineitem}})
  JOIN (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS o_ano FROM {{orders}}) ON l_orderkey=o_orderkey JOIN {{part}} ON l_partkey=p_partkey
  JOIN {{supplier}} ON l_suppkey=s_suppkey JOIN {{nation}} ON s_nationkey=n_nationkey
 GROUP BY 1,2,3,4,5)"""


def fleet_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot fact as a lazy query over the test tables."""
    return spark.sql(FLEET_NARROW_SQL, **{t: table(spark, sf_dir, t) for t in FLEET_TABLES})


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/periodica-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, sf_dir: str, name: str) -> str:
    digest = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:12]
    return f"{_session_folder(spark)}/{name}-{digest}"


def _written(
    spark: SparkSession, sf_dir: str, name: str, plan: Callable[[], DataFrame], write, read
) -> DataFrame:
    """``plan()`` written to the shared folder once per session and data set, then scanned.

    The frame is kept, so that the listing of its files is not repeated. ``build_tables`` does it in one step,
    ``remove_tables`` undoes it.
    """
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    path = _path(spark, sf_dir, name)
    if key not in _frames:
        write(plan(), path)
        release_shuffles(spark)
        _frames[key] = read(spark, path)
    elif _frames[key].sparkSession is not spark:
        _frames[key] = read(spark, path)
    return _frames[key]


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot fact as a period-partitioned table.

    Queries read it the way they would in production: partitions pruned by period, row groups
    by model, no join repeated.
    """
    return _written(
        spark,
        sf_dir,
        "fleet",
        lambda: fleet_plan(spark, sf_dir),
        write_facts,
        lambda session, path: read_facts(session, path).drop(DEFAULT_SPEC.lineage),
    )


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GLOSSARY_SQL, part=table(spark, sf_dir, "part"))


def _write_glossary(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def glossary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glossary as the CSV file it usually is."""
    return _written(
        spark, sf_dir, "glossario", lambda: glossary(spark, sf_dir), _write_glossary, read_glossary
    )


def loaded_period(
    spark: SparkSession, sf_dir: str, period: str, rows: Callable[[], DataFrame]
) -> DataFrame:
    """A table into which ``rows`` of one period were loaded twice. They are derived once, and both loads read them from the shared folder."""

    def stage(frame: DataFrame, path: str) -> None:
        frame.write.mode("overwrite").parquet(path)

    def load_twice(frame: DataFrame, path: str) -> None:
        replace_period(frame, path, period)
        replace_period(frame, path, period)

    def staged() -> DataFrame:
        return _written(spark, sf_dir, "consolidado", rows, stage, lambda session, path: session.read.parquet(path))

    return _written(spark, sf_dir, "carga", staged, load_twice, read_facts)


def kept_pairs(spark: SparkSession, sf_dir: str, changes: dict[str, str]) -> DataFrame:
    """The table of stock pairs after monthly loads: it was built when the periods of ``changes`` were "missing" or "wrong"."""

    def load_and_refresh(frame: DataFrame, path: str) -> None:
        facts, pairs = f"{path}/fato", f"{path}/pares"
        period = F.col(DEFAULT_SPEC.period)
        missing = [day for day, state in changes.items() if state == "missing"]
        wrong = F.when(period.isin([day for day, state in changes.items() if state == "wrong"]), 3).otherwise(1)
        units = (F.col(DEFAULT_SPEC.measure) * wrong).alias(DEFAULT_SPEC.measure)
        early = frame.filter(~period.isin(missing)).select(*(units if c == DEFAULT_SPEC.measure else c for c in frame.columns))
        copy_facts(early, facts)
        build_pairs(read_facts(spark, facts), pairs)
        for day in changes:
            replace_period(frame.filter(period == F.lit(day).cast("date")), facts, day)
            refresh_pairs(read_facts(spark, facts), pairs, [day])

    return _written(
        spark, sf_dir, "pares", lambda: fleet(spark, sf_dir), load_and_refresh, lambda session, path: read_pairs(session, f"{path}/pares")
    )


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of the fact's codes; two periods of it were refreshed after it was built without one and with the other's half."""

    def build_and_refresh(frame: DataFrame, path: str) -> None:
        period, model = F.col(DEFAULT_SPEC.period), F.col(DEFAULT_SPEC.model)
        late, partial = (F.lit(day).cast("date") for day in (p.REF, p.LOAD_PERIOD))
        build_codes(frame.filter((period != late) & ((period != partial) | (F.length(model) % 2 == 0))), path)
        refresh_codes(frame, path, [p.REF, p.LOAD_PERIOD])

    return _written(spark, sf_dir, "codigos", lambda: fleet(spark, sf_dir), build_and_refresh, read_codes)


def raw_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(RAW_SQL, fleet=fleet(spark, sf_dir))
    return rows.select([F.col(c).alias(header) for c, header in LAYOUTS[0].items()])


def _write_text(rows: DataFrame, path: str) -> None:
    (
        rows.write.mode("overwrite")
        .option("sep", ";")
        .option("header", True)
        .option("encoding", "ISO-8859-1")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def raw_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry text files as the ingest job meets them, without the lineage column."""
    return _written(
        spark,
        sf_dir,
        "registro",
        lambda: raw_plan(spark, sf_dir),
        _write_text,
        lambda session, path: read_registry(session, path).drop(DEFAULT_SPEC.lineage),
    )


def registry_folder(spark: SparkSession, sf_dir: str) -> str:
    """The path of the files that ``raw_registry`` reads."""
    raw_registry(spark, sf_dir)
    return _path(spark, sf_dir, "registro")


def _write_layouts(lines: DataFrame, path: str) -> None:
    # One text column, whose name is the files' header; nothing is quoted. The lines leave an array of one: the choice of a layout would
    # otherwise be moved below them and derive each line's columns over and over, in code too long to be compiled.
    lines = lines.select(F.inline(F.array(F.struct("layout", "linha"))))
    # Compressed, as text of short columns takes several times the room; a file that cannot be split is kept short.
    packed = {"compression": "gzip", "maxRecordsPerFile": 1_000_000}
    for number, layout in enumerate(LAYOUTS):
        rows = lines.filter(F.col("layout") == number).select(F.col("linha").alias(";".join(layout.values())))
        options = {"sep": "\u0001", "quote": "\u0000", "header": True, "encoding": "ISO-8859-1"}
        kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        rows.write.mode("overwrite").options(**options, **kept, **packed).csv(f"{path}/layout{number}")


def registry_files(spark: SparkSession, sf_dir: str) -> RegistryFiles:
    """Registry text of two headers with malformed records, as ``read_registry_files`` reads it."""
    key = "registros"
    lines = lambda: spark.sql(LINES_SQL, fleet=fleet(spark, sf_dir)).select("layout", "linha")
    _written(spark, sf_dir, key, lines, _write_layouts, lambda session, path: session.read.text(f"{path}/*"))
    return read_registry_files(spark, f"{_path(spark, sf_dir, key)}/*")


def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the second of two equal monthly loads into a copy of the fact table. The text is staged once, and both take it from there."""

    def load_twice(frame: DataFrame, path: str) -> None:
        copy_facts(frame, f"{path}/fato")
        source = registry_folder(spark, sf_dir)
        staged = stage_months(spark, {p.LOAD_PERIOD: source}, BRAND_A, lineage=p.SOURCE_FILE)
        for _ in range(2):
            report = load_staged_month(staged, f"{path}/fato", p.REF)
        report.write.mode("overwrite").parquet(f"{path}/relatorio")

    return _written(
        spark, sf_dir, "relatorio", lambda: fleet(spark, sf_dir), load_twice, lambda session, path: session.read.parquet(f"{path}/relatorio")
    )


def many_months(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    """The fact ("fato") or the report ("relatorio") after the texts of both headers were loaded twice, each as a month, in one job; they are staged once."""

    def load_twice(frame: DataFrame, path: str) -> None:
        copy_facts(frame, f"{path}/fato")
        registry_files(spark, sf_dir)
        texts = _path(spark, sf_dir, "registros")
        sources = {day: f"{texts}/layout{number}" for number, day in enumerate(p.LOAD_PERIODS)}
        aside = {"quarantine": f"{path}/quarentena", "max_rejected": 1 << 40}
        staged = stage_months(spark, sources, BRAND_A, lineage=p.SOURCE_FILE, **aside)
        for _ in range(2):
            report = load_staged_months(staged, f"{path}/fato")
        report.write.mode("overwrite").parquet(f"{path}/relatorio")

    fact = _written(spark, sf_dir, "meses", lambda: fleet(spark, sf_dir), load_twice, lambda session, path: read_facts(session, f"{path}/fato"))
    return fact if what == "fato" else spark.read.parquet(f"{_path(spark, sf_dir, 'meses')}/{what}")


def brand_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BRAND_B_SQL, fleet=fleet(spark, sf_dir))


def build_tables(spark: SparkSession, sf_dir: str) -> None:
    """Write the tables that the keyed queries scan, so that no query does it on its first use."""
    fleet(spark, sf_dir)
    glossary_file(spark, sf_dir)
    raw_registry(spark, sf_dir)


def remove_tables(spark: SparkSession) -> None:
    """Remove what this session has written to the shared folder, loads included."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    for key in [k for k in _frames if k[0] == spark.sparkContext.applicationId]:
        del _frames[key]
