"""Several periods replaced in one job."""

from __future__ import annotations

import gzip
import time
from datetime import date

import pytest

from periodica.plans import build_pairs, load_months, read_pairs, stage_months, stale_periods
from periodica.presets import BRAND_A
from periodica.session import release_shuffles
from periodica.sources import TooManyRejected, read_facts, replace_periods, write_facts
from tests.conftest import rows
from workload import views

HEADER = "UF;Município;Marca Modelo;Ano Fabricação;Qtd. Veículos"


def table_rows(spark, path=None, table=None):
    return sorted(map(repr, rows(read_facts(spark, path, table=table).drop("filename"))))


@pytest.fixture(params=["path", "table"])
def target(request, spark, facts, tmp_path):
    """Where the fact of months 1 to 4 is: a path or a catalog table."""
    data = facts(*[(m, "H-D/A", 2020, 10 * m) for m in (1, 2, 3, 4)])
    if request.param == "path":
        write_facts(data, str(tmp_path / "fato"))
        yield {"path": str(tmp_path / "fato"), "table": None}
    else:
        spark.sql("DROP TABLE IF EXISTS muitos_meses")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
        write_facts(data, table="muitos_meses")
        yield {"path": None, "table": "muitos_meses"}
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "static"
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        spark.sql("DROP TABLE IF EXISTS muitos_meses")


def test_periods_are_swapped_together(spark, facts, target):
    new = facts((2, "H-D/B", 2021, 7), (5, "H-D/B", 2021, 8), (2, "H-D/A", 2020, 1))
    for _ in range(2):
        replace_periods(new, target["path"], ["2024-02-01", date(2024, 5, 1), "2024-03-01"], table=target["table"])
        got = {(str(r.competencia), r.marca_modelo): r.qtd_veiculos for r in read_facts(spark, **target).collect()}
        assert got == {
            ("2024-01-01", "H-D/A"): 10,
            ("2024-02-01", "H-D/A"): 1,
            ("2024-02-01", "H-D/B"): 7,
            ("2024-04-01", "H-D/A"): 40,
            ("2024-05-01", "H-D/B"): 8,
        }


def test_a_failed_load_leaves_all_months(spark, facts, target):
    before = table_rows(spark, **target)
    for bad in (facts((2, "H-D/B", 2021, 7), (3, "H-D/B", 2021, 7)), facts((2, "H-D/B", 2021, 7))):
        with pytest.raises(Exception, match="a row of competencia 2024-02-01 in a load of 2024-03-01, 2024-04-01"):
            replace_periods(bad, target["path"], ["2024-03-01", "2024-04-01"], table=target["table"])
        assert table_rows(spark, **target) == before


def written(folder, name, *lines):
    (folder / name).write_bytes("\n".join([HEADER, *lines, ""]).encode("latin-1"))
    return str(folder / name)


def test_load_of_many_months(spark, facts, tmp_path):
    fact, pairs, aside = (str(tmp_path / n) for n in ("fato", "pares", "lado"))
    write_facts(facts((1, "H-D/A", 2020, 10), (3, "H-D/A", 2020, 30)), fact)
    build_pairs(read_facts(spark, fact), pairs)
    sources = {
        "2024-02-01": [written(tmp_path, "f1.txt", "SP;X;H-D/A;2020;4", "SP;X;YAMAHA/R1;2020;9"), written(tmp_path, "f2.txt", "SP;X;H-D/A;2020;6")],
        date(2024, 4, 1): written(tmp_path, "a.txt", "SP;X;H-D/B;;8", "curto"),
        "2024-05-01": written(tmp_path, "m.txt", "SP;X;YAMAHA/R1;2020;9"),
    }
    want = [
        (date(2024, 2, 1), 3, 2, 1, 10, 10, 0, 0),
        (date(2024, 4, 1), 2, 1, 1, 30, 8, -22, 1),
        (date(2024, 5, 1), 1, 0, 0, None, 0, None, 0),
    ]
    for _ in range(2):
        report = load_months(spark, sources, fact, BRAND_A, pairs=pairs, quarantine=aside, max_rejected=1, lineage="entrega")
        assert rows(report) == want
        assert stale_periods(read_facts(spark, fact), read_pairs(spark, pairs)).count() == 0
        assert read_facts(spark, fact).count() == 4
    before = table_rows(spark, fact)
    with pytest.raises(TooManyRejected):
        load_months(spark, sources, fact, BRAND_A, quarantine=aside)
    with pytest.raises(Exception, match="(?i)malformed"):
        load_months(spark, sources, fact, BRAND_A)
    assert table_rows(spark, fact) == before
    assert [c for c in load_months(spark, {"2024-02-01": sources["2024-02-01"]}, fact, BRAND_A).columns if "rejeitadas" in c] == []


def test_a_load_leaves_no_shuffle_files(spark, facts, tmp_path):
    """The files of a step's shuffles go when its rows are written, and do not lie beside those of the next."""
    write_facts(facts((1, "H-D/A", 2020, 10)), str(tmp_path / "fato"))
    source = written(tmp_path, "a.txt", "SP;X;H-D/A;2020;5")
    shuffles = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()

    def settled(most=0):
        until = time.time() + 15
        while shuffles.size() > most and time.time() < until:
            time.sleep(0.2)
        return shuffles.size()

    release_shuffles(spark)
    before = settled()
    staged = stage_months(spark, {"2024-02-01": source}, BRAND_A)
    assert settled(before) <= before
    assert staged.groups.count() == 1


def test_registry_texts_are_compressed(spark, tmp_path):
    lines = [(0, "SP;São Paulo;H-D/A;2020;5"), (0, ' "x";;;;'), (1, "7;H-D/B;RJ;2021;Rio;b;sobra")]
    views._write_layouts(spark.createDataFrame(lines, "layout int, linha string"), str(tmp_path))
    for number, layout in enumerate(views.LAYOUTS):
        files = list((tmp_path / f"layout{number}").glob("part-*"))
        assert files and all(f.name.endswith(".gz") for f in files)
        texts = [gzip.open(f, "rt", encoding="ISO-8859-1").read().splitlines() for f in files]
        assert all(t[0] == ";".join(layout.values()) for t in texts)
        assert sorted(x for t in texts for x in t[1:]) == sorted(x for n, x in lines if n == number)
