"""What the driver imports."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def keys(*hidden: str) -> list[str]:
    """Keys of the queries in an interpreter in which some modules cannot be imported."""
    code = f"import sys; sys.modules.update(dict.fromkeys({list(hidden)!r})); import __spark_entry__ as e; e.oracle_sql(); print(*e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return done.stdout.split()


def test_library_queries_need_nothing_of_the_corpus_part():
    from workload.oracle import oracle_sql
    from workload.queries import queries

    library = list(queries())
    assert sorted(oracle_sql()) == sorted(library) and len(library) >= 94
    assert keys("periodica.llm") == library
    assert keys("corpus_pipeline") == library
    assert keys("xxhash", "zstandard") == library
