from __future__ import annotations

import pytest
from oracle import connect, same

from knotwork.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, name):
    same(QUERIES[name](spark, small), connect(small), ORACLE_SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
