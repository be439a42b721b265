"""Every core query against its SQL, or for its schema alone."""

import pytest

from orbweave.queries import general, reference
from tests.oracle import connect, rows

DATA = "/root/testdata/sf0.001"
QUERIES = general.QUERIES | reference.QUERIES
SQL = general.SQL | reference.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = connect(DATA).sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0
