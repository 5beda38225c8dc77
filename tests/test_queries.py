"""Every core query runs; those with SQL give the same rows."""

import pytest

from archivolt.plans.queries import QUERIES, SQL
from tests.oracle import of_sql, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    frame = QUERIES[name](spark, data).toArrow()
    if name in SQL:
        same(frame, of_sql(SQL[name], data))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
