"""Every registered query of the library runs, and gives what its SQL gives."""

import numpy as np
import pytest

from compare import duck, rows
from quayside.jobs.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, db, name):
    got, want = QUERIES[name](spark, sf).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) and not got.isna().all().any()
    numbers = got.select_dtypes("number")
    assert np.isfinite(numbers.to_numpy(float)[~numbers.isna().to_numpy()]).all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
