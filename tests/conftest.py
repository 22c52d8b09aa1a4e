from __future__ import annotations

import os
import sys
import tempfile
from datetime import date

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from periodica.session import build_session  # noqa: E402
from periodica.spec import DEFAULT_SPEC  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "periodica-tests",
        os.environ.get("TEST_MASTER", "local[8]"),
        spark__sql__shuffle__partitions=4,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getConf().get("spark.checkpoint.dir"):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="periodica-tests-"))
    yield session
    session.stop()


NAMES = DEFAULT_SPEC.columns
TYPES = [pa.date32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]


@pytest.fixture(scope="session")
def facts(spark):
    """Build a fact frame from (period month, model, year, units[, state, city]) tuples."""

    def build(*rows):
        full = []
        for month, model, year, units, *place in rows:
            state, city = (place + ["SP", "SAO PAULO"][len(place) :]) if len(place) < 2 else place
            period = month if isinstance(month, date) else date(2024 + (month - 1) // 12, (month - 1) % 12 + 1, 1)
            full.append((period, state, city, model, year, units, None))
        columns = zip(*full, strict=True)
        return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES))

    return build


def rows(frame):
    return [tuple(r) for r in frame.collect()]
