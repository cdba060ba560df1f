"""Every registered query against its SQL, or for its number of rows where it has none."""

import duckdb
import numpy as np
import pytest

from quillet import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str(tuple(float(x) + 0.0 if isinstance(x, (float, np.floating)) else x for x in map(lambda v: v.item() if hasattr(v, "item") else v, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, data, db, name):
    got = catalogue.queries()[name](spark, data).toPandas()
    if name in catalogue.oracle_sql():
        want = db.sql(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0
