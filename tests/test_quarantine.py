"""Registry files of several headers, malformed records set aside."""

from __future__ import annotations

import gzip

import pytest

from periodica.plans import load_month
from periodica.presets import BRAND_A
from periodica.sources import TooManyRejected, read_facts, read_registry_files
from tests.conftest import rows

ONE = "UF;Município;Marca Modelo;Ano Fabricação;Qtd. Veículos"
OTHER = "Qtd Veiculos;MARCA MODELO;UF;Ano Fabricacao;Municipio;Origem"
COLUMNS = ["uf", "municipio", "marca_modelo", "ano_fabricacao", "qtd_veiculos"]


@pytest.fixture
def folder(tmp_path):
    """A folder of two headers, in names with blanks, one file compressed."""
    place = tmp_path / "registro de abril"
    place.mkdir()
    first = [ONE, "SP;São Paulo;H-D/A;2020;4", "SP;X;H-D/A;2020", "", 'RJ;"a;b";H-D/A;2020;5', "SP;X;H-D/A;2020;6;", "SP;X;YAMAHA/R1;2020;9"]
    second = [OTHER, "7;H-D/B;SP;;X;o1", "8;H-D/B;SP;;X;o1;mais", OTHER, "1;H-D/B;RJ;;Y;"]
    (place / "um 1.txt").write_bytes("\n".join([*first, ""]).encode("latin-1"))
    (place / "dois.txt").write_bytes("\r\n".join(second).encode("latin-1"))
    (place / "três.txt.gz").write_bytes(gzip.compress("\n".join([ONE, "AC;Z;H-D/A;2019;2", "curto"]).encode("latin-1")))
    return place


def bad_lines(files):
    return sorted((r.arquivo.rsplit("/", 1)[1].split(".")[0][:2], r.linha, r.registro, r.motivo) for r in files.rejected().collect())


def test_two_headers_and_malformed_records(spark, folder):
    files = read_registry_files(spark, str(folder))
    got = sorted(map(tuple, files.accepted.select(*COLUMNS, "Origem").collect()), key=repr)
    assert got == sorted(
        [
            ("SP", "São Paulo", "H-D/A", "2020", "4", None),
            ("RJ", "a;b", "H-D/A", "2020", "5", None),
            ("SP", "X", "YAMAHA/R1", "2020", "9", None),
            ("SP", "X", "H-D/B", None, "7", "o1"),
            ("RJ", "Y", "H-D/B", None, "1", None),
            ("AC", "Z", "H-D/A", "2019", "2", None),
        ],
        key=repr,
    )
    assert files.accepted.select("filename").distinct().count() == 3
    assert bad_lines(files) == [
        ("do", 3, "8;H-D/B;SP;;X;o1;mais", "campos demais"),
        ("tr", 3, "curto", "campos de menos"),
        ("um", 3, "SP;X;H-D/A;2020", "campos de menos"),
        ("um", 6, "SP;X;H-D/A;2020;6;", "campos demais"),
    ]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    """A file that is read in many blocks, a malformed record every 100 lines."""
    lines = [ONE] + [f"SP;Cidade {i};H-D/A;2020;{i}" if i % 100 else f"curto {i}" for i in range(2, 5001)]
    (tmp_path / "grande.txt").write_bytes("\n".join(lines).encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        files = read_registry_files(spark, str(tmp_path / "grande.txt"))
        assert files.lines.rdd.getNumPartitions() > 5
        got = sorted((r.linha, r.registro) for r in files.rejected().collect())
        assert files.accepted.count() == 4949
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, f"curto {i}") for i in range(100, 5001, 100)]


def test_header_without_a_required_column_fails(spark, tmp_path):
    (tmp_path / "a.txt").write_text("UF;Marca Modelo\nSP;H-D/A\n")
    with pytest.raises(ValueError, match="no header matches"):
        read_registry_files(spark, str(tmp_path / "a.txt"))


def test_load_sets_aside_up_to_the_limit(spark, folder, tmp_path):
    table, aside = str(tmp_path / "fatos"), str(tmp_path / "quarentena")
    load = dict(period="2026-04-01", previous="2026-03-01", brand=BRAND_A, quarantine=aside)
    with pytest.raises(TooManyRejected, match="4 malformed records, 3 allowed"):
        load_month(spark, str(folder), table, **load, max_rejected=3)
    assert spark.read.parquet(aside).count() == 4
    with pytest.raises(Exception, match="(?i)path"):
        read_facts(spark, table).count()  # nothing was replaced
    for _ in range(2):
        report = load_month(spark, str(folder), table, **load, max_rejected=4)
        assert rows(report) == [(10, 5, 5, 0, 19, 19, 4)]
    assert spark.read.parquet(aside).columns == ["arquivo", "linha", "registro", "motivo"]
    units = {r.marca_modelo: r.q for r in read_facts(spark, table).groupBy("marca_modelo").agg({"qtd_veiculos": "sum"}).toDF("marca_modelo", "q").collect()}
    assert units == {"H-D/A": 11, "H-D/B": 8}


def test_a_clean_load_reads_the_text_once(spark, tmp_path, monkeypatch):
    from periodica.plans import monthly_load

    (tmp_path / "r.txt").write_bytes(f"{ONE}\nSP;X;H-D/A;2020;4\n".encode("latin-1"))
    monkeypatch.setattr(monthly_load, "read_registry", None)
    aside = tmp_path / "quarentena"
    report = load_month(spark, str(tmp_path / "r.txt"), str(tmp_path / "f"), "2026-04-01", "2026-03-01", BRAND_A, quarantine=str(aside))
    assert rows(report) == [(1, 1, 1, 0, 4, 4, 0)] and not aside.exists()


def test_a_record_is_parsed_once(spark, folder):
    """A filter on fields stays above the parser: below it, it would parse each record once more."""
    accepted = read_registry_files(spark, str(folder)).accepted
    kept = accepted.filter(BRAND_A.filter.matches(accepted.marca_modelo))
    text = kept._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_csv(") == 2  # one for each header
    rejected = read_registry_files(spark, str(folder)).rejected()._jdf.queryExecution().optimizedPlan().toString()
    assert rejected.count("from_csv(") == 4  # and once more if it is malformed


def test_plain_records_are_cut_as_the_parser_cuts(spark, tmp_path):
    """A record without quotes is not handed to the CSV parser, with the same fields, NULLs and reasons."""
    from pyspark.sql import functions as F

    from periodica.sources import quarantine

    bodies = ["a;b;c;d;e", ";;;;", " a ; b;;d;e ", "a;b;c;d", "a;b;c;d;e;", "a;b;c;d;e;f", "a", "\t", " ;\t;c;d;e", "\0a;b;c;d;e", "a\0;b;c;d;e", "á;ç;\\;;|", 'a;"b;c";d;e;f', 'a;"";c;d;e', '"a;b;c;d', "a#;b;c;d;e"]
    lines = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(bodies)], "_arquivo string, _bloco bigint, _numero bigint, _registro string")
    got = quarantine._parsed(lines, ONE, 5, ";").orderBy("_numero").collect()
    options = {"sep": ";", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_texto"}
    schema = "_c0 string, _c1 string, _c2 string, _c3 string, _c4 string, _texto string"
    wanted = lines.select("_numero", F.from_csv("_registro", schema, options).alias("r")).select("_numero", "r.*").orderBy("_numero").collect()
    assert [r._malformado for r in got] == [r._texto is not None for r in wanted]
    fine = [i for i, r in enumerate(got) if not r._malformado]
    assert [got[i][-5:] for i in fine] == [wanted[i][1:6] for i in fine] and len(fine) >= 8
    assert [r._motivo for r in got][3:7] == ["campos de menos", "campos demais", "campos demais", "campos de menos"]
    assert "split(" in quarantine._parsed(lines, ONE, 5, ";")._jdf.queryExecution().optimizedPlan().toString()


def test_staged_texts_are_parsed_once_for_two_loads(spark, folder, tmp_path, monkeypatch):
    """The quarantine and both loads come from what was staged: no parsed record is asked for again."""
    from periodica.plans import load_staged_month, stage_months

    aside, table = str(tmp_path / "quarentena"), str(tmp_path / "fatos")
    monkeypatch.setattr("periodica.sources.quarantine.RegistryFiles.rejected", None)
    staged = stage_months(spark, {"2026-04-01": str(folder)}, BRAND_A, quarantine=aside, max_rejected=4)
    for text in folder.iterdir():
        text.write_bytes(b"")
    for _ in range(2):
        assert rows(load_staged_month(staged, table, "2026-03-01")) == [(10, 5, 5, 0, 19, 19, 4)]
    kept = sorted((r.arquivo.rsplit("/", 1)[1][:2], r.linha, r.registro, r.motivo) for r in spark.read.parquet(aside).collect())
    assert kept == [
        ("do", 3, "8;H-D/B;SP;;X;o1;mais", "campos demais"),
        ("tr", 3, "curto", "campos de menos"),
        ("um", 3, "SP;X;H-D/A;2020", "campos de menos"),
        ("um", 6, "SP;X;H-D/A;2020;6;", "campos demais"),
    ]
