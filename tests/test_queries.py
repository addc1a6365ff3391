import pytest

import __spark_entry__
from rasterloom import queries as core

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, SF, core.QUERIES[name], core.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.verified for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
