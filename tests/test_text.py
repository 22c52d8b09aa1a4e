from __future__ import annotations

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from periodica.functions import numbers, text
from periodica.functions.dates import bucket_label, bucket_start, month_label, within_trailing_months
from periodica.operators.enrich import classify_by_text, friendly_name, is_independent_import, is_premium, with_family
from periodica.operators.ingest import canonical_code
from periodica.presets import BRAND_A, BRAND_B


def apply(spark, values, *expressions, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    got = frame.select("i", *(e.alias(f"r{n}") for n, e in enumerate(expressions))).orderBy("i").collect()
    return [tuple(r)[1:] if len(expressions) > 1 else r[1] for r in got]


def col():
    return F.col("c")



def test_normalize_text(spark):
    values = [" são  paulo ", None, "H-D/F  LHXSE", "\tÀÇÉ\xa0ñ\x1fx\r\n", "½ ª º", "straße", "é"]
    assert apply(spark, values, text.normalize_text(col())) == [
        "SAO PAULO", "", "H-D/F LHXSE", "ACE N X", "1⁄2 A O", "STRASSE", "E",
    ]


# Letters whose upper case both Unicode versions at hand know: the files' Latin-1, and the decomposable ones beyond.
_LETTERS = [chr(c) for c in range(0x250) if c < 0x100 or unicodedata.decomposition(chr(c))]


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from(_LETTERS), max_size=12), min_size=20, max_size=40))
def test_normalize_text_follows_unicode_decomposition(spark, values):
    def expected(value):
        plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
        return " ".join(plain.upper().split())

    assert apply(spark, values, text.normalize_text(col())) == [expected(v) for v in values]


def test_no_information_bucket(spark):
    values = ["SEM INFORMAÇÃO", " Sem Informação ", "SEM INFORMACAO", "sem  informação", "SEM", None]
    strict, lenient = text.is_no_information(col()), text.is_no_information(col(), accent_sensitive=False)
    assert apply(spark, values, strict) == [True, True, False, False, False, None]
    assert apply(spark, values, lenient) == [True, True, True, True, False, False]


def test_normalize_label(spark):
    assert apply(spark, [" são josé \n", "Ñandú"], text.normalize_label(col())) == ["SAO JOSE", "ÑANDU"]


def test_like_treats_backslash_as_text(spark):
    values = ["A\\B/FLHX", "flhx", "FL_X"]
    assert apply(spark, values, text.like_ignore_case(col(), "%a\\b%")) == [True, False, False]
    assert apply(spark, values, text.like_ignore_case(col(), "%FL_x%")) == [True, True, True]


def test_title_case(spark):
    values = ["SANTA BÁRBARA D'OESTE", "X-Y z", "supplier#01", None]
    assert apply(spark, values, text.title_case(col())) == ["Santa Bárbara D'Oeste", "X-Y Z", "Supplier#01", None]


def test_numbers(spark):
    values = ["7", " 2.5 ", "3.5", "x", "12d", "NaN", "Infinity", "1e2", "", None, "-1.5", "2015.0", "1999.5", "1e999", "99999999999"]
    assert apply(spark, values, numbers.parse_quantity(col())) == [7, 2, 4, 0, 0, 0, 0, 100, 0, 0, -2, 2015, 2000, 0, 99999999999]
    years = [7, None, None, None, None, None, None, 100, None, None, None, 2015, None, None, None]
    assert apply(spark, values, numbers.parse_year(col())) == years


def test_share_is_rounded_on_the_binary_value(spark):
    share = numbers.round_binary(numbers.percent(col(), F.lit(20000)))
    assert apply(spark, [201, 0], share, kind="bigint") == [1.0, 0.0]
    assert apply(spark, [5], numbers.percent(col(), F.lit(0)), kind="bigint") == [None]


def test_period_labels(spark):
    frame = spark.sql("SELECT DATE '2026-04-01' AS c UNION ALL SELECT DATE '2025-11-01'")
    got = {
        str(r[0]): tuple(map(str, r))[1:]
        for r in frame.select(
            "c",
            bucket_label(col(), "month"), bucket_start(col(), "quarter"), bucket_label(col(), "quarter"),
            bucket_start(col(), "semester"), bucket_label(col(), "semester"), month_label(col()),
        ).collect()
    }
    assert got["2026-04-01"] == ("Apr/26", "2026-04-01", "2026T2", "2026-01-01", "S1/2026", "abr/26")
    assert got["2025-11-01"] == ("Nov/25", "2025-10-01", "2025T4", "2025-07-01", "S2/2025", "nov/25")
    with pytest.raises(ValueError):
        bucket_start(col(), "week")


def test_trailing_months(spark):
    frame = spark.sql("SELECT add_months(DATE '2024-01-01', CAST(id AS INT)) AS c FROM range(12)")
    kept = frame.filter(within_trailing_months(col(), "2024-06-01", 3)).agg(F.min("c"), F.max("c"), F.count("c")).first()
    assert tuple(map(str, kept)) == ("2024-04-01", "2024-06-01", "3")
    assert frame.filter(within_trailing_months(col(), "2024-06-01", None)).count() == 6


def test_brand_filters(spark):
    values = ["H-D/FLHX", "h.davidson/xl", "I/HARLEY DAVIDSON FATBOY", "FORD/HARLEY", "XH-D/A", "MOTO DAVIDSON", None]
    assert apply(spark, values, BRAND_A.filter.matches(col())) == [True, True, True, False, False, True, False]
    values = ["INDIAN/SCOUT", "i/índian  scout", "IMP/INDIAN", "INDIAN", "INDIANA/X", "X INDIAN/", "I/INDIAN-FTR", None]
    assert apply(spark, values, BRAND_B.filter.matches(col())) == [True, True, True, True, False, False, True, False]


def test_code_aliases(spark):
    values = ["HarleyDavidson/FLHTCI", " I/H.  Davidson FXR ", " h-d/Flhx ", None]
    got = apply(spark, values, canonical_code(col(), BRAND_A.aliases))
    assert got == ["HARLEY DAVIDSON/FLHTCI", "I/H. Davidson FXR".replace("H. Davidson", "H.DAVIDSON"), "h-d/Flhx", None]


def families(spark, *pairs):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, codigo_modelo string, nome_amigavel string")
    return [r["family"] for r in with_family(frame).orderBy("i").collect()]


def test_family_rules_apply_in_order(spark):
    got = families(
        spark,
        ("H-D/FLHXL", ""), ("H-D/FXLRS", ""), ("H-D/FXDL", "Low Rider"), ("H-D/FXDL", ""), ("H-D/F LHX", ""),
        ("X", "Tri Glide Trike"), ("X", "Trike"), ("RA1250S", "Sportster"), ("H-D/XG750", ""), ("VRSCF", ""),
        ("FLD", ""), ("WLA", None), ("FLSTN", ""),
    )
    assert got == [
        "Sportster", "Sportster", "Softail", "Dyna", "Touring", "Touring", "Trike", "Adventure", "Street", "V-Rod",
        "Dyna", "Outras familias", "Softail",
    ]


def test_second_brand_families_and_names(spark):
    values = ["I/INDIAN CHIEF SPRINGFLD", "INDIAN/CHIEF SPRINGFIELD", "IMP/INDIAN", "i/índian  scout", "INDIAN/FTR", "X", "I/INDIAN CHIEF CHIEFT DH"]
    assert apply(spark, values, classify_by_text(col(), BRAND_B.families, BRAND_B.default_family)) == [
        "Chief", "Springfield", "Heritage / Classic", "Scout", "FTR", "Outras", "Chief",
    ]
    assert apply(spark, values, friendly_name(col(), BRAND_B.names)) == [
        "Chief Springfield", "Chief Springfield", "Indian (Heritage Import)", "Scout", "INDIAN/FTR", "X",
        "Chief Chieftain Dark Horse",
    ]


def test_flags(spark):
    values = [" imp/x", "I/Y", "H-D/I/", "H-D/FLHX SE ", None]
    assert apply(spark, values, is_independent_import(col())) == [True, True, False, False, False]
    assert apply(spark, values, is_premium(col(), F.lit(None).cast("string"))) == [False, False, False, True, False]
    assert apply(spark, ["x"], is_premium(col(), F.lit("a cvo b"))) == [True]
