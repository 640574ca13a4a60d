"""Operators over small fixed documents against literal results."""

import duckdb
import pytest

from tests.fixed_documents import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_golden(spark, name):
    df = QUERIES[name](spark, None)
    cols = sorted(df.columns)
    rel = duckdb.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want and want
