"""Every registered query of the library against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, name):
    df = registry.queries()[name](spark, DATA)
    rows = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows and len(set(df.columns)) == len(df.columns)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = con.sql(sql)
    names, data = got.columns, got.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in data)
