from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from periodica.llm import personal_data as P
from tests.llm.frames import MEDIUM, needs_tables, no_documents, odd_documents


def slow_base(text):
    """(start, kind, end) of the base spans: every match of the patterns, less those that fail."""
    found = []
    for number, (kind, pattern) in enumerate(P.BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(n) > 255 for n in m.group().split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = [sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            found.append((m.start(), number, m.end()))
    return sorted(found)


def base(text):
    return [s for s in P.finder()(text) if s[1] < len(P.BASE)]


@pytest.mark.parametrize("letters", ["0123456789.", "09.-+ ()", "a@.b@-", "1 -2", "a@.b1:/", "+1 (2)-.", "é1٣@. -"])
def test_base_equals_patterns(letters):
    rng, find = random.Random(letters), P.finder()
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert [s for s in find(text) if s[1] < 4] == slow_base(text)
        addresses = [(m.start(), m.end()) for m in re.finditer(P.ADDRESS, text)]
        assert [(a, b) for a, k, b in find(text) if k == 4] == addresses


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 OK.", ["account:DE89 3704 0044 0532 0130 00"]),
        ("iban DE89370400440532013001", []),
        ("Account no. 12345678, account 123", ["account:12345678"]),
        ("my SSN: 123-45-6789; lessn 123-45-6789", ["account:123-45-6789"]),
        ("passport C01234567x passport C01234567", ["account:C01234567"]),
        ("ftp://bob:pw@host.example:21/x http://host.example/", ["address:ftp://bob:pw@host.example:21", "email:pw@host.example"]),
        ("1.2.3.4.5.6.7.8 001.02.3.4 256.1.1.1", ["ip:1.2.3.4", "ip:5.6.7.8", "ip:001.02.3.4"]),
        ("É a@b.c@d.e", ["email:a@b.c"]),
        ("4111 1111-1111 1111, +1 (743) 555-3824.", ["card:4111 1111-1111 1111", "phone:+1 (743) 555-3824"]),
    ],
)
def test_what_is_found(text, want):
    assert [f"{P.KINDS[k]}:{text[a:b]}" for a, k, b in P.finder()(text)] == want


@pytest.mark.parametrize("unit", ["1", "1.", "a@", "a://", "+1", "account ", "1 ", "a"])
def test_long_texts_take_linear_time(unit):
    """The patterns by themselves need quadratic time for some of these."""
    assert base(unit * 300 + "@") == slow_base(unit * 300 + "@")
    start = time.perf_counter()
    base(unit * 500_000 + "@")
    assert time.perf_counter() - start < 30


def test_odd_frames(spark):
    odd = odd_documents(spark)
    rows = P.count_kinds(P.with_personal_data(odd)).collect()
    assert len(rows) == odd.count() and not any(r.spans for r in rows)
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert P.count_kinds(P.with_personal_data(no_documents(spark))).count() == 0
    clash = spark.createDataFrame([(1, "x@y.z", "a", "b")], "doc_id int, text string, PERSONAL string, `a.b` string")
    found = P.with_personal_data(clash)
    assert found.columns == ["doc_id", "text", "a.b", "personal"]
    assert P.redacted(clash).collect() == [(1, "<email>", "a", "b")]
    assert sorted(map(str, P.redacted(odd).collect())) == sorted(map(str, odd.collect()))


def test_redaction_joins_overlaps(spark):
    text = "at ftp://bob:pw@host.example:21/x and x@y.z."
    docs = spark.createDataFrame([(text,)], "text string")
    assert P.redacted(docs).first()[0] == "at <address>/x and <email>."


@needs_tables
def test_query_equals_brute_force(spark):
    from periodica.llm.queries import op11_personal_data

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = op11_personal_data(spark, MEDIUM).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = slow_base(texts[r.doc_id])
        joined = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in spans) for i in range(4))
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in P.BASE] == [s for s in joined.split(",") if s]
    assert sum(r.n_email for r in rows) > 5
