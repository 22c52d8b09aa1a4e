"""DuckDB SQL for the keyed queries, written from the definitions and apart from the Spark code."""

from __future__ import annotations

from workload import params as p
from workload import views

_TABLES = {t: t for t in views.FLEET_TABLES}
_FLEET = views.FLEET_SQL.format(**_TABLES)
_GLOSSARY = views.GLOSSARY_SQL.format(**_TABLES)
_RAW = views.RAW_SQL.format(fleet="fleet")
_LINES = views.LINES_SQL.format(fleet="fleet")
_BRAND = views.BRAND_B_SQL.format(fleet="fleet")


def _list(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def _cte(**views_: str) -> str:
    return ", ".join(f"{name} AS ({sql})" for name, sql in views_.items())


def _sql(body: str, **extra: str) -> str:
    """``body`` over fleet and further named views; extra views come in the order given."""
    return f"WITH {_cte(fleet=_FLEET, **extra)}\n{body}"


REF = f"DATE '{p.REF}'"
YEARS = _list(p.YEARS)
AT_REF = f"competencia = {REF}"


def _units(column: str = "qtd_veiculos", name: str = "total") -> str:
    return f"CAST(SUM({column}) AS BIGINT) AS {name}"


def _pct(part: str, whole: str) -> str:
    return f"100.0 * CAST({part} AS DOUBLE) / NULLIF({whole}, 0)"


# -- text and ingest ----------------------------------------------------------------------------


def _norm(c: str) -> str:
    return f"trim(regexp_replace(upper(strip_accents(coalesce({c}, ''))), '\\s+', ' ', 'g'))"


_IS_A = (
    "(NOT contains({n}, 'FORD') AND (contains({n}, 'HARLEY') OR contains({n}, 'DAVIDSON')"
    " OR starts_with({n}, 'H-D/') OR starts_with({n}, 'H.DAVIDSON/')))"
)
_IS_B = "(regexp_matches({n}, '^(I/)?INDIAN([ /-]|$)') OR regexp_matches({n}, '^IMP/INDIAN([ /-]|$)'))"
_ALIASES = """(VALUES ('HARLEYDAVIDSON/FLHTCI', 'HARLEY DAVIDSON/FLHTCI'),
 ('HARLEYDAVIDSON/FLHTK TRI', 'HARLEY DAVIDSON FLHT TRI'), ('I/H. DAVIDSON FXR', 'I/H.DAVIDSON FXR'),
 ('I/HARLEY DAVIDSON FATBOY', 'H-D/FLFB')) a(de, para)"""
_NAMED = """SELECT uf_texto AS uf, municipio_texto AS municipio, marca_texto AS marca_modelo,
 ano_texto AS ano_fabricacao, qtd_texto AS qtd_veiculos FROM raw"""


def _number(c: str) -> str:
    pattern = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return f"CASE WHEN regexp_full_match(trim({c}), '{pattern}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


_TYPED = f"""SELECT DATE '{p.LOAD_PERIOD}' AS competencia, trim(uf) AS uf, trim(municipio) AS municipio,
 coalesce(para, trim(marca_modelo)) AS marca_modelo,
 CASE WHEN y = floor(y) THEN CAST(y AS INT) END AS ano_fabricacao,
 coalesce(CAST(round_even(q, 0) AS BIGINT), 0) AS qtd_veiculos, '{p.SOURCE_FILE}' AS filename
FROM (SELECT *, {_norm('marca_modelo')} AS n, {_number('ano_fabricacao')} AS y, {_number('qtd_veiculos')} AS q FROM named)
LEFT JOIN {_ALIASES} ON de = n WHERE {_IS_A.format(n='n')}"""

_RAW_VIEWS = {"raw": _RAW, "named": _NAMED}
_TYPED_VIEWS = {**_RAW_VIEWS, "typed": _TYPED}
_CONSOLIDATED = f"""SELECT competencia, uf, municipio, marca_modelo, ano_fabricacao, {_units(name='qtd_veiculos')}, filename
FROM typed GROUP BY competencia, uf, municipio, marca_modelo, ano_fabricacao, filename"""

# -- flows --------------------------------------------------------------------------------------

_PERIODS = """SELECT competencia AS c, lag(competencia) OVER (ORDER BY competencia) AS prev
FROM (SELECT DISTINCT competencia FROM fleet)"""
_BY_MODEL = "SELECT competencia AS c, marca_modelo AS m, SUM(qtd_veiculos) AS q FROM fleet GROUP BY ALL"
# A key that vanishes adds no positive flow, so the current rows are enough.
_MODEL_FLOW = """SELECT s.c, s.m, CASE WHEN prev IS NULL THEN 0 ELSE greatest(s.q - coalesce(b.q, 0), 0) END AS f
FROM by_model s JOIN periods USING (c) LEFT JOIN by_model b ON b.c = prev AND b.m = s.m"""
_FLOW_VIEWS = {"periods": _PERIODS, "by_model": _BY_MODEL, "model_flow": _MODEL_FLOW}

_BY_YEAR = "SELECT competencia AS c, marca_modelo AS m, ano_fabricacao AS y, SUM(qtd_veiculos) AS q FROM fleet GROUP BY ALL"
_RAW_FLOW = """SELECT s.c, s.m, s.y, CASE WHEN prev IS NULL THEN 0 ELSE greatest(s.q - coalesce(b.q, 0), 0) END AS raw
FROM by_year s JOIN periods USING (c) LEFT JOIN by_year b ON b.c = prev AND b.m = s.m AND b.y = s.y WHERE s.y IS NOT NULL"""
_UNKNOWN_DROP = """SELECT periods.c, b.m, greatest(b.q - coalesce(s.q, 0), 0) AS d
FROM periods JOIN (FROM by_year WHERE y IS NULL) b ON b.c = prev
LEFT JOIN (FROM by_year WHERE y IS NULL) s ON s.c = periods.c AND s.m = b.m"""
_GROWTH = "SELECT c, m, SUM(raw) AS grown FROM raw_flow GROUP BY c, m"
_CORRECTED = """SELECT r.c, r.y, CASE WHEN raw > 0 AND grown > 0
 THEN CAST(raw AS DOUBLE) * greatest(grown - coalesce(d, 0), 0) / grown ELSE 0 END AS e
FROM raw_flow r JOIN growth USING (c, m) LEFT JOIN unknown_drop USING (c, m)"""
# Years known at the period or at the one before; periods without such a year on one side get a NULL row.
_CELLS = """SELECT c, y FROM by_year WHERE y IS NOT NULL UNION
SELECT periods.c, y FROM by_year b JOIN periods ON b.c = prev WHERE y IS NOT NULL UNION
SELECT c, NULL FROM periods WHERE NOT EXISTS (FROM by_year k WHERE k.c = periods.c AND y IS NOT NULL)
 OR NOT EXISTS (FROM by_year k WHERE k.c = periods.prev AND y IS NOT NULL)"""
_REGISTRATIONS = """SELECT cells.c AS competencia, cells.y AS ano_fabricacao, coalesce(e, 0) AS emplacamentos,
 t AS emplacamentos_total FROM cells
LEFT JOIN (SELECT c, y, SUM(e) AS e FROM corrected GROUP BY c, y) k ON k.c = cells.c AND k.y = cells.y
JOIN (SELECT c, CAST(SUM(f) AS BIGINT) AS t FROM model_flow GROUP BY c) w ON w.c = cells.c"""
_REG_VIEWS = {
    **_FLOW_VIEWS,
    "by_year": _BY_YEAR,
    "raw_flow": _RAW_FLOW,
    "unknown_drop": _UNKNOWN_DROP,
    "growth": _GROWTH,
    "corrected": _CORRECTED,
    "cells": _CELLS,
    "reg": _REGISTRATIONS,
}


def _six(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _registrations(columns: str, rest: str = "", **extra: str) -> str:
    return _sql(f"SELECT {columns} FROM reg {rest}", **_REG_VIEWS, **extra)


_GRAINS = {
    "month": ("competencia", "strftime(competencia, '%b/%y')"),
    "quarter": (
        "CAST(date_trunc('quarter', competencia) AS DATE)",
        "concat(year(competencia), 'T', quarter(competencia))",
    ),
    "semester": (
        "make_date(year(competencia), CASE WHEN month(competencia) < 7 THEN 1 ELSE 7 END, 1)",
        "concat(CASE WHEN month(competencia) < 7 THEN 'S1/' ELSE 'S2/' END, year(competencia))",
    ),
}


def _trailing(months: int) -> str:
    return f"competencia <= {REF} AND competencia >= CAST({REF} - INTERVAL {months - 1} MONTH AS DATE)"


def _bucketed(grain: str, body: str) -> str:
    """``body`` over ``b``: registrations of the window with period_start and period_label."""
    start, label = _GRAINS[grain]
    rows = f"SELECT *, {start} AS period_start, {label} AS period_label FROM reg WHERE {_trailing(p.MONTHS_BACK)}"
    totals = """SELECT period_start, period_label, CAST(SUM(t) AS BIGINT) AS total FROM
 (SELECT DISTINCT competencia, period_start, period_label, emplacamentos_total AS t FROM b) GROUP BY ALL"""
    known = """SELECT period_start, period_label, ano_fabricacao, SUM(emplacamentos) AS e
 FROM b WHERE ano_fabricacao IS NOT NULL GROUP BY ALL"""
    return _sql(body, **_REG_VIEWS, b=rows, totals=totals, known=known)


_UNATTRIBUTED = f"""SELECT period_start, period_label, {_six('greatest(total - coalesce(e, 0), 0)')} AS emplacamentos,
 'MY nao identificado' AS serie
FROM totals LEFT JOIN (SELECT period_start, SUM(e) AS e FROM known GROUP BY 1) USING (period_start)"""

# -- pending ------------------------------------------------------------------------------------

_Y = p.PENDING_YEAR
_PENDING = f"""SELECT * FROM fleet WHERE upper(trim(municipio)) = 'SEM INFORMAÇÃO'
 AND marca_modelo IN (SELECT marca_modelo FROM fleet WHERE ano_fabricacao = {_Y})
 AND year(competencia) IN ({_Y - 1}, {_Y})"""
_PENDING_SERIES = f"""SELECT competencia, COUNT(DISTINCT marca_modelo) AS modelos, {_units(name='total_sem_info')}
FROM pending GROUP BY competencia"""

# -- matrices -----------------------------------------------------------------------------------

_MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
_CUT = int(p.REF[5:7])


def _month_cells(value: str) -> str:
    return ", ".join(
        f"CAST(coalesce(SUM({value}) FILTER (WHERE month(competencia) = {i}), 0) AS BIGINT) AS {m}"
        if i <= _CUT
        else f"CAST(NULL AS BIGINT) AS {m}"
        for i, m in enumerate(_MONTHS, 1)
    )


_STOCK_MATRIX = f"""SELECT marca_modelo, {_month_cells('qtd_veiculos')} FROM fleet
WHERE ano_fabricacao IN ({YEARS}) AND year(competencia) = {p.REF[:4]} AND competencia <= {REF} GROUP BY marca_modelo"""
_MODEL_LAG = f"""SELECT marca_modelo, competencia,
 greatest(q - coalesce(lag(q) OVER (PARTITION BY marca_modelo ORDER BY competencia), 0), 0) AS f
FROM (SELECT marca_modelo, competencia, SUM(qtd_veiculos) AS q FROM fleet
 WHERE ano_fabricacao IN ({YEARS}) AND competencia <= {REF} GROUP BY ALL)"""
_FLOW_MATRIX = f"""SELECT marca_modelo, {_month_cells('f')} FROM model_lag
WHERE year(competencia) = {p.REF[:4]} GROUP BY marca_modelo"""
_LABEL = "concat(upper(mes[1]), mes[2:])"

# -- territory ----------------------------------------------------------------------------------


def _territory(keys: str) -> str:
    previous = f"(SELECT MAX(competencia) FROM fleet WHERE competencia < {REF})"

    def side(when: str, name: str) -> str:
        return f"""(SELECT {keys}, SUM(qtd_veiculos) AS {name} FROM fleet
 WHERE competencia = {when} AND ano_fabricacao IN ({YEARS}) GROUP BY ALL)"""

    return f"""SELECT {keys}, CAST(coalesce(a, 0) AS BIGINT) AS total_atual, CAST(coalesce(z, 0) AS BIGINT) AS total_anterior,
 CAST(coalesce(a, 0) - coalesce(z, 0) AS BIGINT) AS delta_liquido,
 CAST(greatest(coalesce(a, 0) - coalesce(z, 0), 0) AS BIGINT) AS ganho_mensal
FROM {side(REF, 'a')} FULL JOIN {side(previous, 'z')} USING ({keys})"""


def _title(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')"


# -- families -----------------------------------------------------------------------------------

# (family, tokens in code and name, tokens in the code)
_FAMILIES = [
    ("Adventure", "PAN AMERICA", "RA1250"),
    ("Sportster", "SPORTSTER|IRON 883|IRON 1200|FORTY-EIGHT|ROADSTER|NIGHTSTER", "XL|RH975|RH1250|XR1200"),
    (
        "Touring",
        "ROAD GLIDE|STREET GLIDE|ROAD KING|ULTRA|ELECTRA GLIDE|TRI GLIDE|FREEWHEELER|LIMITED",
        "FLHX|FLHT|FLHR|FLTR",
    ),
    (
        "Softail",
        "FAT BOY|BREAKOUT|HERITAGE|STREET BOB|LOW RIDER|SOFTAIL|SLIM|DELUXE|SPRINGER|ROCKER|CROSS BONES",
        "FLST|FLFB|FLHC|FXBB|FXBR|FXLRS|FXSB|FXST",
    ),
    ("Dyna", "DYNA|SWITCHBACK|WIDE GLIDE|SUPER GLIDE", "FXD|FLD"),
    ("V-Rod", "V-ROD|NIGHT ROD|MUSCLE", "VRSC"),
    ("Street", "STREET 750|STREET 500", "XG"),
    ("Trike", "TRIKE", "TRIKE"),
]
_CODE = "replace(upper(trim(codigo_modelo)), ' ', '')"
_FAMILY = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches(concat({_CODE}, ' ', upper(trim(nome_amigavel))), '{text}')"
        f" OR regexp_matches({_CODE}, '{code}') THEN '{family}'"
        for family, text, code in _FAMILIES
    )
    + " ELSE 'Outras familias' END"
)
_FAMILY_B = f"""CASE WHEN contains({{n}}, 'SCOUT') THEN 'Scout' WHEN contains({{n}}, 'SPRINGFIELD') THEN 'Springfield'
 WHEN contains({{n}}, 'ROADMASTER') THEN 'Roadmaster' WHEN contains({{n}}, 'CHIEFTAIN') THEN 'Chieftain'
 WHEN regexp_matches({{n}}, 'CHIEF|DARKHORSE|DARK HORSE|VINTAGE|CLASSIC') THEN 'Chief' WHEN contains({{n}}, 'FTR') THEN 'FTR'
 WHEN {{n}} = 'IMP/INDIAN' THEN 'Heritage / Classic' ELSE 'Outras' END"""

# Friendly names by normalised code.
_NAMES_B = """(VALUES ('INDIAN/SCOUT', 'Scout'), ('I/INDIAN SCOUT', 'Scout'), ('I/INDIAN SCOUT BOBBER', 'Scout Bobber'),
 ('INDIAN/CHIEF VINTAGE', 'Chief Vintage'), ('I/INDIAN CHIEF VINTAGE', 'Chief Vintage'),
 ('INDIAN/CHIEF CLASSIC', 'Chief Classic'), ('INDIAN/CHIEF SPRINGFIELD', 'Chief Springfield'),
 ('I/INDIAN CHIEF SPRINGFLD', 'Chief Springfield'), ('INDIAN/CHIEF ROADMASTER', 'Chief Roadmaster'),
 ('I/INDIAN CHIEF ROADMASTR', 'Chief Roadmaster'), ('INDIAN/CHIEF CHIEFTAIN', 'Chief Chieftain'),
 ('I/INDIAN CHIEF CHIEFTAIN', 'Chief Chieftain'), ('I/INDIAN CHIEF CHIEFT DH', 'Chief Chieftain Dark Horse'),
 ('I/INDIAN CHIEF DARKHORSE', 'Chief Dark Horse'), ('I/INDIAN CHIEF', 'Chief'),
 ('IMP/INDIAN', 'Indian (Heritage Import)'), ('I/INDIAN BOARD TRACK RAC', 'Board Track Racer'),
 ('I/INDIAN VINTAGE LE', 'Vintage LE')) nomes(codigo, nome)"""

_MODELS = f"SELECT marca_modelo, {_units()} FROM fleet WHERE {AT_REF} GROUP BY marca_modelo"
_DISPLAY = "CASE WHEN trim(nome_amigavel) <> '' THEN concat(codigo_modelo, ' | ', nome_amigavel) ELSE codigo_modelo END"


def _enriched(source: str, columns: str) -> str:
    return f"""SELECT *, {_DISPLAY} AS nome_exibicao FROM (SELECT {columns}, marca_modelo AS codigo_modelo,
 coalesce(g.nome_amigavel, '') AS nome_amigavel FROM {source} LEFT JOIN glossary g ON g.codigo_modelo = marca_modelo)"""


_LABELLED = f"""SELECT *, {_FAMILY} AS family,
 (starts_with(upper(trim(codigo_modelo)), 'I/') OR starts_with(upper(trim(codigo_modelo)), 'IMP/')) AS is_import_indep,
 (contains(upper(trim(nome_amigavel)), 'CVO') OR ends_with({_CODE}, 'SE')) AS is_cvo
FROM ({_enriched('models', 'marca_modelo, total')})"""
_LABELLED_VIEWS = {"glossary": _GLOSSARY, "models": _MODELS, "labelled": _LABELLED}

_BRAND_LABELLED = f"""SELECT bb.*, coalesce(nome, marca_modelo) AS friendly_name, {_FAMILY_B.format(n='n')} AS family
FROM (SELECT *, {_norm('marca_modelo')} AS n FROM brand) bb LEFT JOIN {_NAMES_B} ON codigo = n"""
_BRAND_VIEWS = {"brand": _BRAND, "bl": _BRAND_LABELLED}
_BRAND_PENDING = f"ano_fabricacao IS NULL AND {_norm('municipio')} = 'SEM INFORMACAO'"
_QTD = _units(name="qtd_veiculos")


def _brand(body: str) -> str:
    return _sql(body, **_BRAND_VIEWS)


_LIKE = f"upper(marca_modelo) LIKE upper('{p.PATTERN}')"
_HITS = f"SELECT * FROM fleet WHERE upper(marca_modelo) LIKE upper('%{p.TERM}%') AND {'competencia <= ' + REF}"
_SIX_COLUMNS = "competencia, uf, municipio, marca_modelo, ano_fabricacao, qtd_veiculos"
_CITIES = f"SELECT municipio, uf, {_units()} FROM fleet WHERE {AT_REF} GROUP BY municipio, uf"
_CITY_SHARES = f"""SELECT municipio, uf, total, CAST(SUM(total) OVER (PARTITION BY uf) AS BIGINT) AS total_uf,
 ROUND({_pct('total', 'SUM(total) OVER (PARTITION BY uf)')}, 2) AS share_uf_pct,
 ROUND({_pct('total', 'SUM(total) OVER ()')}, 2) AS share_brasil_pct
FROM cities ORDER BY total DESC, municipio, uf LIMIT {{k}}"""
_KNOWN_YEARS = f"""SELECT ano_fabricacao, {_units()} FROM fleet
WHERE {AT_REF} AND ano_fabricacao IS NOT NULL GROUP BY ano_fabricacao"""
_OF_MODEL = f"marca_modelo = '{p.MODEL}'"
_TOP_MODEL = f"{_MODELS} ORDER BY total DESC, marca_modelo LIMIT"


def _brand_count(condition: str) -> str:
    return _sql(
        f"""SELECT marca_modelo, COUNT(*) AS linhas FROM (SELECT *, {_norm('marca_modelo')} AS n FROM named)
WHERE {condition.format(n='n')} GROUP BY marca_modelo""",
        **_RAW_VIEWS,
    )


def _month_of(layout: int) -> dict[str, str]:
    """Views raw, named, typed and month of the texts of one header, numbered."""
    chain = {"raw": f"FROM lines WHERE layout = {layout} AND defeito = ''", "named": _NAMED, "typed": _TYPED, "month": _CONSOLIDATED}
    numbered = {}
    for before, (name, sql) in zip(["", *chain], chain.items(), strict=False):
        sql = sql.replace(f"FROM {before}", f"FROM {before}{layout}") if before else sql
        numbered[f"{name}{layout}"] = sql.replace(f"DATE '{p.LOAD_PERIOD}'", f"DATE '{p.LOAD_PERIODS[layout]}'")
    return numbered


_MANY = {"lines": _LINES, **_month_of(0), **_month_of(1)}
# Of the second month, which lies behind the history, the one before is the last of the history.
_MANY_REPORT = " UNION ALL ".join(
    f"""SELECT DATE '{day}' AS competencia, (SELECT COUNT(*) FROM lines WHERE layout = {k}) AS linhas_lidas, (SELECT COUNT(*) FROM typed{k}) AS linhas_marca,
 (SELECT COUNT(*) FROM month{k}) AS linhas_consolidadas, z AS total_anterior, a AS total_atual, a - z AS delta,
 (SELECT COUNT(*) FROM lines WHERE layout = {k} AND defeito <> '') AS linhas_rejeitadas
FROM (SELECT CAST(SUM(qtd_veiculos) AS BIGINT) AS a FROM month{k}),
 (SELECT CAST(SUM(qtd_veiculos) AS BIGINT) AS z FROM fleet WHERE competencia = (SELECT MAX(competencia) FROM fleet WHERE competencia < DATE '{day}'))"""
    for k, day in enumerate(p.LOAD_PERIODS)
)

#: Answers from the table of pairs or through the dictionary of codes are those from the fact.
_KEPT = {
    "search_rows_by_codes": "search_rows",
    "family_like_by_codes": "family_like",
    "search_slice_by_codes": "search_slice",
    "registrations_kept": "registrations_macro",
    "annual_flow_kept": "annual_flow",
    "base_builder_kept": "base_builder_ranking",
}


def oracle_sql() -> dict[str, str]:
    found = _statements()
    return found | {kept: found[plain] for kept, plain in _KEPT.items()}


def _statements() -> dict[str, str]:
    return {
        # sources and cleansing
        "ingest_canonical_columns": _sql("FROM named", **_RAW_VIEWS),
        "text_normalize": _sql(
            f"""SELECT texto, {_norm('texto')} AS normalizado
FROM (SELECT marca_modelo AS texto FROM named UNION SELECT municipio FROM named)""",
            **_RAW_VIEWS,
        ),
        "brand_filter_contains": _brand_count(_IS_A),
        "brand_filter_regex": _brand_count(_IS_B),
        "code_canonicalize": _sql(
            "SELECT marca_modelo AS codigo, COUNT(*) AS linhas FROM typed GROUP BY 1", **_TYPED_VIEWS
        ),
        "ingest_typed_rows": _sql("FROM typed", **_TYPED_VIEWS),
        "ingest_consolidate": _sql(_CONSOLIDATED, **_TYPED_VIEWS),
        "ingest_two_headers": _sql(_CONSOLIDATED, lines=_LINES, raw="FROM lines WHERE defeito = ''", named=_NAMED, typed=_TYPED),
        "ingest_rejected": _sql(
            "SELECT linha AS registro, defeito AS motivo, COUNT(*) AS linhas FROM lines WHERE defeito <> '' GROUP BY ALL", lines=_LINES
        ),
        "ingest_many_months": _sql("FROM month0 UNION ALL FROM month1", **_MANY),
        "ingest_many_report": _sql(_MANY_REPORT, **_MANY),
        "ingest_replace_period": _sql(_CONSOLIDATED, **_TYPED_VIEWS),
        "glossary_load": _sql("FROM glossary", glossary=_GLOSSARY),
        "ingest_reconcile": _sql(
            f"""SELECT (SELECT COUNT(*) FROM named) AS linhas_lidas, (SELECT COUNT(*) FROM typed) AS linhas_marca,
 (SELECT COUNT(*) FROM loaded) AS linhas_consolidadas, z AS total_anterior, a AS total_atual, a - z AS delta
FROM (SELECT CAST(SUM(qtd_veiculos) AS BIGINT) AS a FROM loaded),
 (SELECT CAST(SUM(qtd_veiculos) AS BIGINT) AS z FROM fleet WHERE {AT_REF})""",
            **_TYPED_VIEWS,
            loaded=_CONSOLIDATED,
        ),
        # catalogue
        "list_periods": _sql("SELECT DISTINCT competencia FROM fleet"),
        "list_years": _sql("SELECT DISTINCT ano_fabricacao FROM fleet WHERE ano_fabricacao IS NOT NULL"),
        "info": _sql(
            """SELECT MIN(competencia) AS primeira_competencia, MAX(competencia) AS ultima_competencia,
 COUNT(*) AS linhas, COUNT(DISTINCT marca_modelo) AS modelos_distintos FROM fleet"""
        ),
        "distinct_models_sketched": _sql(
            f"""SELECT CAST(year(competencia) AS INT) AS ano, COUNT(DISTINCT competencia) AS periodos, COUNT(*) AS linhas, {_units()},
 COUNT(DISTINCT marca_modelo) AS modelos_distintos, true AS no_limite FROM fleet GROUP BY 1"""
        ),
        "valid_years": _sql("SELECT DISTINCT ano_fabricacao FROM fleet WHERE ano_fabricacao <= 1998"),
        # stock at a period
        "top_models": _sql(f"{_TOP_MODEL} 30"),
        "top_model_year": _sql(f"{_KNOWN_YEARS} ORDER BY total DESC, ano_fabricacao DESC LIMIT 1"),
        "model_year_distribution": _sql(_KNOWN_YEARS),
        "top_model": _sql(f"{_TOP_MODEL} 1"),
        "current_models": _sql(_MODELS),
        "top_cities": _sql(f"{_CITIES} ORDER BY total DESC, municipio, uf LIMIT 20"),
        "models_by_year": _sql(
            f"SELECT marca_modelo, {_units()} FROM fleet WHERE ano_fabricacao = {p.YEARS[0]} GROUP BY 1"
        ),
        "models_by_year_at_period": _sql(
            f"SELECT marca_modelo, {_units()} FROM fleet WHERE ano_fabricacao = {p.YEARS[0]} AND {AT_REF} GROUP BY 1"
        ),
        "fleet_model_at_period": _sql(
            f"SELECT {_SIX_COLUMNS} FROM fleet WHERE {_OF_MODEL} AND {AT_REF}"
        ),
        "fleet_model": _sql(f"SELECT {_SIX_COLUMNS} FROM fleet WHERE {_OF_MODEL}"),
        "model_by_uf": _sql(f"SELECT uf, {_units()} FROM fleet WHERE {_OF_MODEL} AND {AT_REF} GROUP BY uf"),
        "model_by_city": _sql(
            f"""SELECT municipio, uf, {_units()} FROM fleet WHERE {_OF_MODEL} AND {AT_REF}
GROUP BY ALL ORDER BY total DESC, municipio, uf LIMIT 15"""
        ),
        # shares
        "share_by_uf": _sql(
            f"""SELECT uf, CAST(t AS BIGINT) AS total_uf, ROUND({_pct('t', 'SUM(t) OVER ()')}, 2) AS share_percentual
FROM (SELECT uf, SUM(qtd_veiculos) AS t FROM fleet WHERE {AT_REF} GROUP BY uf)"""
        ),
        "city_concentration": _sql(_CITY_SHARES.format(k=20), cities=_CITIES),
        "gold_year": _sql(
            f"""SELECT *, {_pct('total', 'SUM(total) OVER ()')} AS share_pct FROM years
ORDER BY total DESC, ano_fabricacao DESC LIMIT 20""",
            years=_KNOWN_YEARS,
        ),
        "concentration_leaders": _sql(
            f"""SELECT * FROM ({_CITY_SHARES.format(k=30)})
WHERE strip_accents(upper(trim(municipio))) <> 'SEM INFORMACAO' AND total >= 100
ORDER BY share_uf_pct DESC, total DESC, municipio, uf LIMIT 15""",
            cities=_CITIES,
        ),
        "large_cities": _sql(
            f"""SELECT * FROM ({_CITY_SHARES.format(k=30)})
WHERE strip_accents(upper(trim(municipio))) <> 'SEM INFORMACAO' ORDER BY total DESC, municipio, uf LIMIT 15""",
            cities=_CITIES,
        ),
        # stock to flow
        "model_snapshot": _sql(
            f"""SELECT * FROM (SELECT competencia, CAST(q AS BIGINT) AS estoque,
 CAST(q - coalesce(lag(q) OVER (ORDER BY competencia), 0) AS BIGINT) AS delta
 FROM (SELECT competencia, SUM(qtd_veiculos) AS q FROM fleet WHERE {_OF_MODEL} GROUP BY 1)) WHERE {AT_REF}"""
        ),
        "entries_proxy": _sql(
            f"""SELECT * FROM (SELECT competencia, q AS estoque, coalesce(q - lag(q) OVER w, 0) AS liquido,
 greatest(coalesce(q - lag(q) OVER w, 0), 0) AS emplacamentos_proxy
 FROM (SELECT competencia, CAST(coalesce(SUM(qtd_veiculos) FILTER (WHERE {_OF_MODEL}), 0) AS BIGINT) AS q
  FROM fleet GROUP BY competencia) WINDOW w AS (ORDER BY competencia))
WHERE competencia BETWEEN DATE '{p.START}' AND DATE '{p.END}'"""
        ),
        "annual_flow": _sql(
            """SELECT CAST(year(c) AS INT) AS ano, COUNT(DISTINCT c) AS meses_observados, CAST(SUM(f) AS BIGINT) AS vendas_total
FROM model_flow GROUP BY 1""",
            **_FLOW_VIEWS,
        ),
        "base_builder_ranking": _sql(
            f"""SELECT m AS marca_modelo, {_units('f', 'vendas_proxy_total')} FROM
 (SELECT m, f FROM model_flow UNION ALL SELECT NULL, 0) GROUP BY m""",
            **_FLOW_VIEWS,
        ),
        "registrations_macro": _registrations(
            f"competencia, ano_fabricacao, {_six('emplacamentos')} AS emplacamentos, emplacamentos_total"
        ),
        "model_variation": _sql(
            f"""SELECT CAST(a AS BIGINT) AS inicio, CAST(z AS BIGINT) AS fim, CAST(z - a AS BIGINT) AS variacao FROM
 (SELECT SUM(qtd_veiculos) AS a FROM fleet WHERE {_OF_MODEL} AND competencia = DATE '{p.START}'),
 (SELECT SUM(qtd_veiculos) AS z FROM fleet WHERE {_OF_MODEL} AND competencia = DATE '{p.END}')"""
        ),
        "national_snapshot": _sql(
            f"""SELECT * FROM (SELECT competencia, q AS frota_total, {_pct('(q - lag(q) OVER w)', 'lag(q) OVER w')} AS mom_pct
 FROM (SELECT competencia, CAST(SUM(qtd_veiculos) AS BIGINT) AS q FROM fleet GROUP BY 1)
 WINDOW w AS (ORDER BY competencia)) WHERE {AT_REF}"""
        ),
        "model_series": _sql(
            f"SELECT competencia, {_units(name='estoque')} FROM fleet WHERE {_OF_MODEL} GROUP BY 1"
        ),
        # buckets and residuals
        "trailing_window": _registrations(
            f"competencia, ano_fabricacao, {_six('emplacamentos')} AS emplacamentos, emplacamentos_total",
            f"WHERE {_trailing(12)}",
        ),
        "period_bucket": _sql(
            "SELECT competencia, "
            + ", ".join(f"{s} AS {g}_start, {label} AS {g}_label" for g, (s, label) in _GRAINS.items())
            + " FROM (SELECT DISTINCT competencia FROM fleet)"
        ),
        "registrations_by_bucket_year": _bucketed(
            "quarter",
            f"SELECT period_start, period_label, ano_fabricacao, {_six('e')} AS emplacamentos FROM known",
        ),
        "registrations_total_by_bucket": _bucketed(
            "semester",
            f"SELECT period_start, period_label, {_six('total')} AS emplacamentos, 'Total' AS serie FROM totals",
        ),
        "registrations_unattributed": _bucketed("quarter", _UNATTRIBUTED),
        "active_years": _bucketed("month", "SELECT DISTINCT ano_fabricacao FROM known WHERE e > 0"),
        "selected_years_dense": _bucketed(
            "quarter",
            f"""SELECT g.period_start, g.period_label, CAST(y AS INT) AS ano_fabricacao,
 {_six('coalesce(e, 0)')} AS emplacamentos, concat('MY ', y) AS serie
FROM totals g CROSS JOIN (SELECT unnest([{YEARS}]) AS y)
LEFT JOIN known k ON k.period_start = g.period_start AND k.ano_fabricacao = y""",
        ),
        "other_years_residual": _bucketed(
            "quarter",
            f"""{_UNATTRIBUTED} UNION ALL SELECT period_start, period_label,
 {_six('greatest(coalesce(a, 0) - coalesce(s, 0), 0)')}, 'Outros MYs' FROM totals
LEFT JOIN (SELECT period_start, SUM(e) AS a, SUM(e) FILTER (WHERE ano_fabricacao IN ({YEARS})) AS s
 FROM known GROUP BY 1) USING (period_start)""",
        ),
        "default_years": _bucketed(
            "month",
            f"""SELECT ano_fabricacao FROM (SELECT DISTINCT ano_fabricacao FROM known WHERE e > 0)
WHERE ano_fabricacao >= {int(p.REF[:4]) - 2} ORDER BY 1 DESC LIMIT 3""",
        ),
        "default_years_fallback": _bucketed(
            "month",
            "SELECT ano_fabricacao FROM (SELECT DISTINCT ano_fabricacao FROM known WHERE e > 0) ORDER BY 1 DESC LIMIT 3",
        ),
        # pending stock
        "pending_series": _sql(_PENDING_SERIES, pending=_PENDING),
        "pending_snapshot": _sql(
            f"""SELECT * FROM (SELECT *, CAST(total_sem_info - coalesce(lag(total_sem_info) OVER (ORDER BY competencia), 0)
 AS BIGINT) AS delta_sem_info FROM ({_PENDING_SERIES})) WHERE {AT_REF}""",
            pending=_PENDING,
        ),
        "pending_top_models": _sql(
            f"""SELECT marca_modelo, {_units(name='total_sem_info')} FROM pending WHERE {AT_REF}
GROUP BY 1 ORDER BY total_sem_info DESC, marca_modelo LIMIT 20""",
            pending=_PENDING,
        ),
        "pending_model_series": _sql(
            f"SELECT competencia, marca_modelo, {_units(name='total_sem_info')} FROM pending GROUP BY ALL",
            pending=_PENDING,
        ),
        "pending_total_series": _sql(
            f"SELECT competencia, {_units(name='valor')} FROM pending GROUP BY 1", pending=_PENDING
        ),
        "pending_total_of_models": _sql(
            f"""SELECT competencia, {_units(name='valor')} FROM pending
WHERE marca_modelo IN ({_list(p.SOME_MODELS)}) GROUP BY 1""",
            pending=_PENDING,
        ),
        # matrices
        "stock_matrix": _sql(_STOCK_MATRIX),
        "flow_matrix": _sql(_FLOW_MATRIX, model_lag=_MODEL_LAG),
        "matrix_unpivot_topn": _sql(
            f"""SELECT marca_modelo AS serie, mes, valor, {_LABEL} AS mes_label FROM (UNPIVOT (
 FROM matrix ORDER BY {' + '.join(_MONTHS[:_CUT])} DESC, marca_modelo LIMIT 8)
 ON {', '.join(_MONTHS)} INTO NAME mes VALUE valor)""",
            matrix=_STOCK_MATRIX,
        ),
        "matrix_named_rows": _sql(
            f"""SELECT marca_modelo AS serie, mes, valor, {_LABEL} AS mes_label
FROM (UNPIVOT (FROM matrix WHERE marca_modelo IN ({_list(p.SOME_MODELS)})) ON {', '.join(_MONTHS)} INTO NAME mes VALUE valor)""",
            matrix=_STOCK_MATRIX,
        ),
        "matrix_total_series": _sql(
            f"""SELECT 'Todos os modelos' AS serie, mes, {_units('valor', 'valor')}, {_LABEL} AS mes_label
FROM (UNPIVOT matrix ON {', '.join(_MONTHS)} INTO NAME mes VALUE valor) GROUP BY mes""",
            model_lag=_MODEL_LAG,
            matrix=_FLOW_MATRIX,
        ),
        # territory
        "territory_uf": _sql(_territory("uf")),
        "territory_city": _sql(_territory("uf, municipio")),
        "territory_leaders": _sql(
            f"""SELECT {_title('uf')} AS territorio, ganho_mensal, total_atual, delta_liquido,
 (SELECT CAST(SUM(total_atual) AS BIGINT) FROM tu) AS total_recorte, 'uf' AS nivel
FROM (FROM tu ORDER BY ganho_mensal DESC, total_atual DESC, uf LIMIT 12) UNION ALL
SELECT concat({_title('municipio')}, ' / ', {_title('uf')}), ganho_mensal, total_atual, delta_liquido, NULL, 'municipio'
FROM (FROM tc ORDER BY ganho_mensal DESC, total_atual DESC, uf, municipio LIMIT 15) WHERE municipio IS NOT NULL""",
            tu=_territory("uf"),
            tc=_territory("uf, municipio"),
        ),
        # search
        "search_rows": _sql(f"SELECT {_SIX_COLUMNS} FROM fleet WHERE {_LIKE}"),
        "family_like": _sql(
            f"SELECT competencia, marca_modelo, {_units()} FROM fleet WHERE {_LIKE} GROUP BY ALL"
        ),
        "family_series": _sql(f"SELECT competencia, {_units()} FROM fleet WHERE {_LIKE} GROUP BY 1"),
        "search_slice": _sql(
            f"SELECT {_SIX_COLUMNS} FROM hits WHERE ano_fabricacao IN ({YEARS})", hits=_HITS
        ),
        "search_slice_places": _sql(
            f"""SELECT {_SIX_COLUMNS} FROM hits
WHERE uf IN ({_list(p.SOME_STATES)}) AND municipio IN ({_list(p.SOME_CITIES)})""",
            hits=_HITS,
        ),
        "search_facets": _sql(
            f"""SELECT 'ano_fabricacao' AS faceta, CAST(ano_fabricacao AS VARCHAR) AS valor FROM hits
 WHERE ano_fabricacao <= {p.REF[:4]} UNION SELECT 'uf', uf FROM hits UNION SELECT 'municipio', municipio FROM hits""",
            hits=_HITS,
        ),
        "search_snapshot": _sql(
            f"""SELECT marca_modelo AS codigo_modelo, coalesce(nome_amigavel, '') AS nome_amigavel, ano_fabricacao, {_QTD}
FROM hits LEFT JOIN glossary ON codigo_modelo = marca_modelo
WHERE {AT_REF} AND ano_fabricacao IS NOT NULL GROUP BY ALL""",
            hits=_HITS,
            glossary=_GLOSSARY,
        ),
        "search_series_by_segment": _sql(
            " UNION ALL ".join(
                f"""SELECT competencia, {serie} AS serie, {_units(name='valor')}, '{segment}' AS segmento
FROM named_hits WHERE {serie} IS NOT NULL GROUP BY ALL"""
                for segment, serie in (
                    ("consolidated", f"'Busca: {p.TERM}'"),
                    ("model", "nome_exibicao"),
                    ("year", "CAST(ano_fabricacao AS VARCHAR)"),
                    ("state", "uf"),
                    ("city", "municipio"),
                )
            ),
            hits=_HITS,
            glossary=_GLOSSARY,
            named_hits=_enriched("hits", _SIX_COLUMNS),
        ),
        # names, families, flags
        "enrich_models": _sql(
            _enriched("models", "marca_modelo, total"), glossary=_GLOSSARY, models=_MODELS
        ),
        "codes_by_name": _sql(
            "SELECT DISTINCT codigo_modelo FROM glossary WHERE lower(nome_amigavel) = 'fat boy'",
            glossary=_GLOSSARY,
        ),
        "classify_family": _sql(
            f"SELECT codigo_modelo, nome_amigavel, {_FAMILY} AS family FROM ({_enriched('models', 'marca_modelo')})",
            glossary=_GLOSSARY,
            models="SELECT DISTINCT marca_modelo FROM fleet",
        ),
        "labelled_snapshot": _sql("FROM labelled", **_LABELLED_VIEWS),
        "normalize_label": _sql(
            "SELECT DISTINCT municipio, strip_accents(upper(trim(municipio))) AS rotulo FROM fleet"
        ),
        "month_label_pt": _sql(
            f"""SELECT competencia, concat(([{_list(_MONTHS)}])[month(competencia)], strftime(competencia, '/%y')) AS rotulo
FROM (SELECT DISTINCT competencia FROM fleet)"""
        ),
        "classify_family_b": _brand("SELECT DISTINCT marca_modelo, family FROM bl"),
        "friendly_name_b": _brand("SELECT DISTINCT marca_modelo, friendly_name FROM bl"),
        "family_mix": _sql(
            f"""SELECT family, total, {_pct('total', 'SUM(total) OVER ()')} AS share_pct,
 coalesce(family = (SELECT family FROM labelled WHERE family IN ('Touring', 'Softail', 'Sportster')
  GROUP BY family ORDER BY SUM(total) DESC, family LIMIT 1), false) AS lider
FROM (SELECT family, {_units('total')} FROM labelled GROUP BY family)""",
            **_LABELLED_VIEWS,
        ),
        "premium_pyramid": _sql(
            " UNION ALL ".join(
                f"""SELECT '{label}' AS categoria, CAST(coalesce(SUM(total) FILTER (WHERE {flag}), 0) AS BIGINT) AS total,
 {_pct(f'coalesce(SUM(total) FILTER (WHERE {flag}), 0)', 'SUM(total)')} AS share_pct FROM labelled"""
                for label, flag in (("CVOs", "is_cvo"), ("Importacao independente", "is_import_indep"))
            ),
            **_LABELLED_VIEWS,
        ),
        "premium_top": _sql(
            " UNION ALL ".join(
                f"""(SELECT '{label}' AS categoria, codigo_modelo, nome_amigavel, total FROM labelled WHERE {flag}
ORDER BY total DESC, codigo_modelo LIMIT 12)"""
                for label, flag in (("CVOs", "is_cvo"), ("Importacao independente", "is_import_indep"))
            ),
            **_LABELLED_VIEWS,
        ),
        "base_builder_top": _sql(
            _enriched("ranking", "marca_modelo, vendas_proxy_total"),
            **_FLOW_VIEWS,
            glossary=_GLOSSARY,
            ranking=f"""SELECT m AS marca_modelo, {_units('f', 'vendas_proxy_total')} FROM model_flow
GROUP BY m ORDER BY vendas_proxy_total DESC, m LIMIT 15""",
        ),
        # one-period brand report
        "brand_kpis": _brand(
            f"""SELECT {_units()}, COUNT(DISTINCT marca_modelo) AS modelos, any_value(tm.friendly_name) AS modelo_lider,
 any_value(tm.t) AS modelo_lider_total, any_value(ty.y) AS my_lider, any_value(ty.t) AS my_lider_total,
 CAST(coalesce(SUM(qtd_veiculos) FILTER (WHERE {_BRAND_PENDING}), 0) AS BIGINT) AS pendente
FROM brand, (SELECT friendly_name, {_units(name='t')} FROM bl GROUP BY marca_modelo, friendly_name
 ORDER BY t DESC, friendly_name, marca_modelo LIMIT 1) tm,
 (SELECT coalesce(CAST(ano_fabricacao AS VARCHAR), 'Sem MY') AS y, {_units(name='t')} FROM brand
 GROUP BY ano_fabricacao ORDER BY t DESC, ano_fabricacao DESC NULLS LAST LIMIT 1) ty"""
        ),
        "brand_models": _brand(f"SELECT marca_modelo, friendly_name, {_QTD} FROM bl GROUP BY ALL"),
        "brand_family_mix": _brand(
            f"""SELECT family, q AS qtd_veiculos, {_pct('q', 'SUM(q) OVER ()')} AS share_pct
FROM (SELECT family, {_units(name='q')} FROM bl GROUP BY family)"""
        ),
        "brand_by_uf": _brand(
            f"SELECT uf, {_QTD} FROM brand GROUP BY uf ORDER BY SUM(qtd_veiculos) DESC, uf LIMIT 12"
        ),
        "brand_by_city": _brand(
            f"""SELECT municipio, uf, {_QTD} FROM brand GROUP BY ALL
ORDER BY SUM(brand.qtd_veiculos) DESC, municipio, uf LIMIT 15"""
        ),
        "brand_city_list": _brand(
            f"""SELECT uf, municipio, {_QTD}, municipio || ' / ' || uf AS territorio FROM brand
WHERE marca_modelo IN ({_list(p.BRAND_MODELS)}) GROUP BY uf, municipio"""
        ),
        "brand_city_detail": _brand(
            f"""SELECT marca_modelo, friendly_name, family, coalesce(CAST(ano_fabricacao AS VARCHAR), 'Sem MY') AS ano_fabricacao,
 {_QTD} FROM bl WHERE uf = '{p.STATE}' AND municipio = '{p.CITY}' GROUP BY 1, 2, 3, 4"""
        ),
        "brand_city_names": _brand(
            f"""SELECT friendly_name, {_QTD} FROM bl WHERE uf = '{p.STATE}' AND municipio = '{p.CITY}'
GROUP BY friendly_name ORDER BY SUM(bl.qtd_veiculos) DESC, friendly_name LIMIT 12"""
        ),
        "brand_model_options": _brand(
            "SELECT DISTINCT marca_modelo, friendly_name FROM bl ORDER BY friendly_name, marca_modelo LIMIT 8"
        ),
        "brand_by_year": _brand(
            f"SELECT coalesce(CAST(ano_fabricacao AS VARCHAR), 'Sem MY') AS ano_fabricacao, {_QTD} FROM brand GROUP BY 1"
        ),
        "brand_pending_models": _brand(
            f"SELECT marca_modelo, friendly_name, {_QTD} FROM bl WHERE {_BRAND_PENDING} GROUP BY ALL"
        ),
    }
