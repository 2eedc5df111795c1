"""Each registered query of the library against its SQL twin, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quaywork.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].copy()
    for c in d:
        if pd.api.types.is_numeric_dtype(d[c]) and not pd.api.types.is_bool_dtype(d[c]):
            d[c] = d[c].astype(float).round(7)
        else:
            d[c] = d[c].astype(object).where(d[c].notna(), None).astype(str)
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    a, b = normal(QUERIES[name](spark, SF).toPandas()), normal(con.execute(ORACLE_SQL[name]).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a:
        if a[c].dtype == float:
            assert np.isclose(a[c], b[c].astype(float), rtol=1e-6, atol=1e-6, equal_nan=True).all(), c
        else:
            assert (a[c] == b[c]).all(), c
