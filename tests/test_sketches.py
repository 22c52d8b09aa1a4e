from __future__ import annotations

from pyspark.sql import functions as F

from periodica.operators import sketches as S
from tests.conftest import rows


def test_united_sketches_stay_within_the_bound(spark):
    fact = spark.range(120_000).selectExpr(
        "make_date(2024, cast(id % 12 as int) + 1, 1) AS competencia", "concat('M', pmod(hash(id), 30011)) AS marca_modelo", "1L AS qtd_veiculos"
    )
    sketches = S.period_sketches(fact)
    quarter = F.quarter("competencia").alias("trimestre")
    exact = {r[0]: r[1] for r in fact.groupBy(quarter).agg(F.countDistinct("marca_modelo")).collect()}
    found = S.distinct_models(sketches, quarter).collect()
    assert {r.trimestre for r in found} == set(exact) and all(r.periodos == 3 and r.linhas == r.total == 30_000 for r in found)
    assert all(abs(r.modelos_estimados - exact[r.trimestre]) <= S.BOUND * exact[r.trimestre] for r in found)
    whole = S.distinct_models(sketches).first()
    assert abs(whole.modelos_estimados - fact.select("marca_modelo").distinct().count()) <= S.BOUND * 30011


def test_small_and_empty(spark, facts):
    fact = facts((1, "A", 2020, 1), (1, "A", 2021, 2), (2, "B", 2020, 3), (2, None, 2020, 4))
    assert rows(S.distinct_models(S.period_sketches(fact))) == [(2, 4, 10, 2)]
    assert rows(S.distinct_models(S.period_sketches(fact.limit(0)))) == [(0, 0, None, 0)]
