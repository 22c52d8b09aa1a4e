"""Shape of the physical plans: what must hold whatever the size of the tables."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import DataFrameWriter

from workload import params as p
from workload import queries as keyed
from workload import views
from workload.views import fleet

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = keyed.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def fact_scans(text: str) -> list[str]:
    """Read schemas of the scans that read data columns of the fact table."""
    schemas = re.findall(r"FileScan parquet.*ReadSchema: struct<([^>]*)>", text)
    return [s for s in schemas if s]


@pytest.mark.parametrize("key", QUERIES)
def test_no_cross_join_and_no_python(spark, key):
    text = plan(QUERIES[key](spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert node not in text


@pytest.mark.parametrize("key", ["top_models", "share_by_uf", "city_concentration", "gold_year", "labelled_snapshot"])
def test_period_queries_read_one_partition(spark, key):
    text = plan(QUERIES[key](spark, SF_DIR))
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "qtd_veiculos" in line]
    assert scans and all(f"= {p.REF})]" in line for line in scans)


def test_registrations_read_the_fact_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(QUERIES["registrations_macro"](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert fact_scans(text) == ["marca_modelo:string,ano_fabricacao:int,qtd_veiculos:bigint"]
    # Sums by (period, model, year) and series by model are the only exchanges of more than
    # calendar size: neither window nor the final aggregate adds one. The calendar reads the first again.
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    keyed = [line for line in exchanges if "marca_modelo" in line]
    assert len(keyed) == 2


@pytest.mark.parametrize(("key", "scans"), [("registrations_macro", 1), ("annual_flow", 1), ("base_builder_ranking", 1), ("trailing_window", 2)])
def test_calendar_comes_from_the_stock(spark, key, scans):
    """The fact is opened once; a bounded question also looks up the period before its first one."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(QUERIES[key](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("FileScan parquet") == scans and "ReusedExchange" in text


def test_previous_period_prunes_at_run_time(spark):
    text = plan(QUERIES["territory_uf"](spark, SF_DIR))
    assert re.search(r"PartitionFilters: \[\(\(competencia#\d+ = 2000-07-01\) OR \(competencia#\d+ = Subquery", text)


def test_one_model_is_pushed_to_the_scan(spark):
    text = plan(QUERIES["fleet_model"](spark, SF_DIR))
    assert f"EqualTo(marca_modelo,{p.MODEL})" in text


def test_fact_table_is_partitioned_by_period(spark):
    folder = os.path.dirname(fleet(spark, SF_DIR).inputFiles()[0])
    assert os.path.basename(folder).startswith("competencia=")


BOUNDED = [
    "entries_proxy", "trailing_window", "registrations_by_bucket_year", "registrations_total_by_bucket",
    "registrations_unattributed", "active_years", "selected_years_dense", "other_years_residual", "default_years",
]


@pytest.mark.parametrize("key", BOUNDED)
def test_bounded_questions_prune_periods(spark, key):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = plan(QUERIES[key](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in text.splitlines() if "FileScan parquet" in line and "qtd_veiculos" in line]
    assert scans
    for line in scans:
        assert re.search(r"competencia#\d+ <= 2000-07-01", line) and re.search(r"competencia#\d+ >= coalesce\(Subquery", line)


@pytest.mark.parametrize("key", ["search_series_by_segment", "brand_kpis", "territory_leaders"])
def test_one_scan_of_the_fact(spark, key):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(QUERIES[key](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len([s for s in fact_scans(text) if "qtd_veiculos" in s]) == 1
    union = text.find("Union")
    assert union < 0 or "rangepartitioning" not in text[union:]


def test_the_choice_of_a_layout_derives_no_line(spark, tmp_path, monkeypatch):
    """Registry lines are filtered by layout after they are derived, not by deriving them in the filter as well."""
    written = []
    monkeypatch.setattr(DataFrameWriter, "csv", lambda writer, path: written.append(writer._df))
    views._write_layouts(spark.sql(views.LINES_SQL, fleet=fleet(spark, SF_DIR)).select("layout", "linha"), str(tmp_path))
    assert len(written) == len(views.LAYOUTS)
    for frame in written:
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_the_fleet_is_that_of_its_sql_and_shuffles_no_code(spark, tmp_path, monkeypatch):
    """Equal to FLEET_SQL with null and repeated keys; the sums are shuffled by the part's key, not by the code spelled from it."""
    tables = {
        "lineitem": """SELECT k AS l_orderkey, p AS l_partkey, s AS l_suppkey, n AS l_linenumber, q AS l_quantity, f AS l_returnflag, CAST(d AS TIMESTAMP_NTZ) AS l_shipdate
          FROM VALUES (1L,1L,1L,1,2.0D,'R','2000-01-05'), (1L,1L,2L,2,3.0D,'R','2000-01-09'), (1L,1L,1L,7,4.0D,'R','2000-01-05'), (2L,-3L,1L,1,5.0D,NULL,'2000-02-05'),
          (2L,2L,2L,3,NULL,'N','2000-02-05'), (2L,2L,2L,NULL,6.0D,'R',NULL), (3L,2L,2L,4,7.0D,'A','2000-02-05'), (NULL,2L,2L,4,7.0D,'A','2000-02-05'),
          (2L,NULL,2L,4,7.0D,'A','2000-02-05'), (2L,24L,NULL,4,7.0D,'A','2000-02-05'), (2L,24L,3L,NULL,7.9D,'A','2000-02-05') AS t(k,p,s,n,q,f,d)""",
        "orders": "SELECT k AS o_orderkey, CAST(d AS TIMESTAMP_NTZ) AS o_orderdate FROM VALUES (1L,'1999-12-01'), (2L,NULL), (2L,'2000-01-01'), (NULL,'2000-01-01') AS t(k,d)",
        "part": "SELECT * FROM VALUES (1L), (2L), (2L), (-3L), (24L), (CAST(NULL AS BIGINT)) AS t(p_partkey)",
        "supplier": "SELECT * FROM VALUES (1L,'a',1), (2L,'b',1), (2L,'a',1), (3L,NULL,2), (4L,'c',NULL) AS t(s_suppkey,s_name,s_nationkey)",
        "nation": "SELECT * FROM VALUES (1,'X'), (2,NULL), (2,'Y') AS t(n_nationkey,n_name)",
    }
    for name, text in tables.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    found = views.fleet_plan(spark, str(tmp_path))
    wanted = spark.sql(views.FLEET_SQL, **{t: views.table(spark, str(tmp_path), t) for t in views.FLEET_TABLES})
    assert found.dtypes == wanted.dtypes
    rows = sorted(map(repr, found.collect()))
    assert rows == sorted(map(repr, wanted.collect())) and len(rows) > 8
    assert re.search(r"Aggregate \[.*p_partkey#\d+L", found._jdf.queryExecution().optimizedPlan().toString())


def test_a_period_loaded_twice_is_derived_once(spark, monkeypatch):
    """Both loads read what was staged."""
    views.raw_registry(spark, SF_DIR)  # whose own table is read by what is replaced below
    loaded = []
    monkeypatch.setattr(views, "replace_period", lambda rows, path, day: loaded.append(rows.inputFiles()))
    monkeypatch.setattr(views, "read_facts", lambda session, path: session.range(0))
    monkeypatch.setattr(views, "_frames", {k: f for k, f in views._frames.items() if k[2] not in ("carga", "consolidado")})
    QUERIES["ingest_replace_period"](spark, SF_DIR)
    assert len(loaded) == 2 and all("/consolidado-" in file for files in loaded for file in files)


@pytest.mark.parametrize("key", ["ingest_many_report", "ingest_reconcile"])
def test_texts_loaded_twice_are_staged_once(spark, monkeypatch, key):
    """Both loads take the text from what was staged, and the table that they change is a copy without a shuffle."""
    views.registry_files(spark, SF_DIR)
    views.raw_registry(spark, SF_DIR)
    staged, copied, loads = [], [], []
    for found, name in ((staged, "stage_months"), (copied, "copy_facts"), (loads, "load_staged_months"), (loads, "load_staged_month")):
        real = getattr(views, name)
        monkeypatch.setattr(views, name, lambda *a, real=real, found=found, **k: (found.append(a[0]), real(*a, **k))[1])
    monkeypatch.setattr(views, "_frames", {k: f for k, f in views._frames.items() if k[2] not in ("meses", "relatorio")})
    QUERIES[key](spark, SF_DIR)
    assert len(staged) == len(copied) == 1 and len(loads) == 2 and loads[0] is loads[1]
