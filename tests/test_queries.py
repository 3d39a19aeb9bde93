"""Every registered query against its SQL on the smallest tables."""

import check_queries
import pytest
from conftest import SF

from pairlens.catalog import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert check_queries.compare(df, duck, SQL[name]) is None
    else:
        assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
