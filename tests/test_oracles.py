"""Every query of the domain against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from gapweave import plans  # noqa: F401
from gapweave.plans import skills

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or (not isinstance(v, (list, tuple)) and not hasattr(v, "tolist") and pd.isna(v)):
        return None
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, (list, tuple)):
        return [value(x) for x in v]
    return float(f"{v:.8g}") if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([value(r[k]) for k in order]) for r in data)


ALL_SQL = skills.ORACLE_SQL | skills.SMALL_SQL


@pytest.mark.parametrize("name", sorted(ALL_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = skills.QUERIES[name](spark, SF)
    want = con.sql(ALL_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
