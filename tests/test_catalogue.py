"""Every query of the catalogue against its SQL twin in another engine."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, sf_dir, db, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name not in catalogue.ORACLES:
        return
    want = db.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert (got.isna() == want.isna()).all(axis=None)
    got, want = (x.astype(object).where(x.notna(), None) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=0)
