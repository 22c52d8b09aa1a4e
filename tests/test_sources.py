from __future__ import annotations

from datetime import date

import pytest

from periodica.operators.ingest import consolidate, filter_brand, typed_rows
from periodica.plans import load_month
from periodica.presets import BRAND_A, BRAND_B
from periodica.sources import (
    canonical_columns,
    canonicalize,
    read_facts,
    read_glossary,
    read_registry,
    replace_period,
    write_facts,
)
from tests.conftest import rows

HEADER = "UF;Município;Marca Modelo;Ano Fabricação;Qtd. Veículos"


@pytest.fixture()
def registry(tmp_path):
    def write(*lines, name="registro.txt"):
        path = tmp_path / name
        path.write_bytes("\n".join([HEADER, *lines, ""]).encode("latin-1"))
        return str(path)

    return write


def test_header_roles():
    assert canonical_columns(HEADER.split(";") + ["Outra"]) == {
        "UF": "uf",
        "Município": "municipio",
        "Marca Modelo": "marca_modelo",
        "Ano Fabricação": "ano_fabricacao",
        "Qtd. Veículos": "qtd_veiculos",
    }
    assert canonical_columns([" uf ", "MUNICIPIO", "marca modelo x", "ano fabricacao", "QTD"])["QTD"] == "qtd_veiculos"


def test_two_headers_for_one_role_fail():
    with pytest.raises(ValueError, match="both match"):
        canonical_columns(["Município", "MUNICIPIO 2"])


def test_missing_header_fails(spark):
    with pytest.raises(ValueError, match="no header matches"):
        canonicalize(spark.createDataFrame([("SP",)], "UF string"))


def test_registry_is_read_as_latin1_text(spark, registry):
    raw = canonicalize(read_registry(spark, registry('SP;São Paulo;"H-D/""X""";2015;1', "RJ;;H-D/Y;;")))
    got = raw.orderBy("uf").collect()
    assert [r["municipio"] for r in got] == [None, "São Paulo"]
    assert [r["marca_modelo"] for r in got] == ["H-D/Y", 'H-D/"X"']
    assert all(r["filename"].endswith("registro.txt") for r in got)
    assert {t for _, t in raw.dtypes} == {"string"}


def test_rows_are_trimmed_typed_and_consolidated(spark, registry):
    path = registry(
        " SP ; São Paulo ;H-D/FLHX;2015.0;2.5",
        "SP;São Paulo; H-D/FLHX ;2015;3.5",
        "SP;São Paulo;H-D/FLHX;s/ano;x",
        ";;HARLEYDAVIDSON/FLHTCI;1999.5;12d",
        "SP;São Paulo;FORD/HARLEY;2015;9",
    )
    raw = canonicalize(read_registry(spark, path))
    typed = typed_rows(filter_brand(raw, BRAND_A.filter), BRAND_A, "2026-04-01").drop("filename")
    day = date(2026, 4, 1)
    assert sorted(rows(typed), key=repr) == sorted(
        [
            (day, "SP", "São Paulo", "H-D/FLHX", 2015, 2),
            (day, "SP", "São Paulo", "H-D/FLHX", 2015, 4),
            (day, "SP", "São Paulo", "H-D/FLHX", None, 0),
            (day, None, None, "HARLEY DAVIDSON/FLHTCI", None, 0),
        ],
        key=repr,
    )
    units = consolidate(typed_rows(filter_brand(raw, BRAND_A.filter), BRAND_A, "2026-04-01"))
    assert units.filter("ano_fabricacao = 2015").first()["qtd_veiculos"] == 6
    assert units.count() == 3


def test_period_replacement_is_idempotent_and_leaves_other_months(spark, facts, tmp_path):
    table = str(tmp_path / "fatos")
    base = facts((1, "A", 2020, 5), (2, "A", 2020, 6), (2, "B", None, 1))
    write_facts(base, table)
    update = facts((2, "C", 2021, 9))
    for _ in range(2):
        replace_period(update, table, "2024-02-01")
        got = sorted(rows(read_facts(spark, table).select("competencia", "marca_modelo", "qtd_veiculos")))
        assert got == [(date(2024, 1, 1), "A", 5), (date(2024, 2, 1), "C", 9)]
    replace_period(facts((3, "D", 2021, 1)), table, "2024-03-01")
    months = read_facts(spark, table).groupBy("competencia").count().orderBy("competencia")
    assert rows(months) == [(date(2024, m, 1), 1) for m in (1, 2, 3)]


def test_rows_of_another_period_fail_the_load(spark, facts, tmp_path):
    table = str(tmp_path / "fatos")
    write_facts(facts((1, "A", 2020, 5)), table)
    with pytest.raises(Exception, match="competencia 2024-02-01 in a load of 2024-03-01"):
        replace_period(facts((3, "D", 2021, 1), (2, "E", 2021, 1)), table, "2024-03-01")
    assert read_facts(spark, table).count() == 1


@pytest.fixture()
def catalog_table(spark, facts):
    name = "periodica_test_fatos"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    write_facts(facts((1, "A", 2020, 5), (date(2026, 3, 1), "A", 2020, 10)), table=name)
    yield name
    spark.sql(f"DROP TABLE {name}")


def test_catalog_table_is_loaded_month_by_month(spark, facts, catalog_table):
    for _ in range(2):
        replace_period(facts((2, "C", 2021, 9)), None, "2024-02-01", table=catalog_table)
        got = read_facts(spark, table=catalog_table).select("competencia", "marca_modelo", "qtd_veiculos")
        assert (date(2024, 2, 1), "C", 9) in rows(got) and got.count() == 3
    with pytest.raises(Exception, match="in a load of"):
        replace_period(facts((2, "C", 2021, 9), (3, "C", 2021, 9)), None, "2024-02-01", table=catalog_table)
    replace_period(facts((2, "C", 2021, 9)).filter("false"), None, "2024-02-01", table=catalog_table)
    assert read_facts(spark, table=catalog_table).count() == 2
    with pytest.raises(ValueError, match="either"):
        read_facts(spark, "x", table=catalog_table)


def test_monthly_load_into_a_catalog_table(spark, registry, catalog_table):
    path = registry("SP;X;H-D/A;2020;4", "SP;X;H-D/A;2020;5", "SP;X;YAMAHA/R1;2020;99")
    for _ in range(2):
        report = load_month(spark, path, None, "2026-04-01", "2026-03-01", BRAND_A, table=catalog_table)
        assert rows(report) == [(3, 2, 1, 10, 9, -1)]


def test_load_reads_the_text_once(spark, registry, tmp_path, monkeypatch):
    from periodica.plans import monthly_load

    scans = []
    real = monthly_load.read_registry
    monkeypatch.setattr(monthly_load, "read_registry", lambda *a, **k: scans.append(real(*a, **k)) or scans[-1])
    path = registry("SP;X;H-D/A;2020;4")
    report = load_month(spark, path, str(tmp_path / "fatos"), "2026-04-01", "2026-03-01", BRAND_A)
    assert len(scans) == 1
    assert "Scan csv" not in report._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("line", ["SP;X;H-D/A;2020;4;surplus", "SP;X;H-D/A"])
def test_records_of_another_length_fail(spark, registry, line):
    raw = canonicalize(read_registry(spark, registry("SP;X;H-D/A;2020;4", line)))
    with pytest.raises(Exception, match="(?i)malformed"):
        raw.select("marca_modelo").collect()


def test_files_of_another_header_fail(spark, registry, tmp_path):
    one = registry("SP;X;H-D/A;2020;4")
    other = tmp_path / "outro.txt"
    other.write_bytes("UF;Qtd. Veículos;Marca Modelo;Ano Fabricação;Município\nSP;4;H-D/A;2020;X\n".encode("latin-1"))
    with pytest.raises(Exception, match="(?i)header"):
        read_registry(spark, [one, str(other)]).collect()


def test_shared_folder_must_be_set(spark):
    from periodica.session import shared_folder

    class Bare:
        conf = {}
        sparkContext = type("C", (), {"getConf": staticmethod(dict)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Bare)
    assert shared_folder(spark)


def test_an_empty_load_empties_the_month(spark, facts, tmp_path):
    table = str(tmp_path / "fatos")
    write_facts(facts((1, "A", 2020, 5), (2, "A", 2020, 6)), table)
    replace_period(facts((1, "A", 2020, 5)).filter("false"), table, "2024-02-01")
    assert rows(read_facts(spark, table).select("competencia")) == [(date(2024, 1, 1),)]


def test_period_predicate_prunes_partitions(spark, facts, tmp_path):
    from periodica.operators.stock import current_models

    table = str(tmp_path / "fatos")
    write_facts(facts((1, "A", 2020, 5), (2, "A", 2020, 6)), table)
    plan = current_models(read_facts(spark, table), "2024-02-01")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "PartitionFilters: [isnotnull(competencia" in scan
    assert "ReadSchema: struct<marca_modelo:string,qtd_veiculos:bigint>" in scan


def test_monthly_load(spark, facts, registry, tmp_path):
    table = str(tmp_path / "fatos")
    write_facts(facts((date(2026, 3, 1), "A", 2020, 10)), table)
    path = registry("SP;X;H-D/A;2020;4", "SP;X;H-D/A;2020;5", "SP;X;H-D/B;;6", "SP;X;YAMAHA/R1;2020;99")
    for _ in range(2):
        report = load_month(spark, path, table, "2026-04-01", "2026-03-01", BRAND_A)
        assert rows(report) == [(4, 3, 2, 10, 15, 5)]
    assert read_facts(spark, table).count() == 3
    # Another brand finds nothing in this file: its month is emptied.
    assert rows(load_month(spark, path, table, "2026-04-01", "2026-03-01", BRAND_B)) == [(4, 0, 0, 10, 0, -10)]


def test_glossary(spark, tmp_path):
    path = tmp_path / "glossario.csv"
    path.write_text("codigo_modelo,nome_amigavel\nH-D/X,Fat Boy\nH-D/Y,\n")
    assert sorted(rows(read_glossary(spark, str(path)))) == [("H-D/X", "Fat Boy"), ("H-D/Y", "")]
    path.write_text("codigo_modelo\nH-D/X\n")
    assert rows(read_glossary(spark, str(path))) == [("H-D/X", "")]
    missing = read_glossary(spark, str(tmp_path / "nada.csv"))
    assert missing.columns == ["codigo_modelo", "nome_amigavel"] and missing.count() == 0


def test_a_copy_is_neither_shuffled_nor_sorted_again(spark, facts, tmp_path, monkeypatch):
    """A table whose files are laid out keeps its rows, its periods and the order inside them."""
    from pyspark.sql import DataFrameWriter

    from periodica.sources import copy_facts

    data = facts(*[(m, f"H-D/{(i * 7) % 50:02d}", 2020, i) for m in (1, 2, 3) for i in range(50)], (2, None, None, None))
    first, second = str(tmp_path / "um"), str(tmp_path / "dois")
    write_facts(data, first)
    plans, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda writer, *a, **k: (plans.append(writer._df._jdf.queryExecution().executedPlan().toString()), real(writer, *a, **k))[1])
    for _ in range(2):
        copy_facts(read_facts(spark, first), second)
    assert len(plans) == 2 and not any("Exchange" in text or "Sort" in text for text in plans)
    assert sorted(map(repr, rows(read_facts(spark, second)))) == sorted(map(repr, rows(read_facts(spark, first))))
    for day in ("2024-01-01", "2024-03-01"):
        codes = [r.marca_modelo for r in spark.read.parquet(f"{second}/competencia={day}").collect()]
        assert codes == sorted(codes) and len(codes) == 50
