"""Every query against its reference SQL (sf0.001, or SIFTMILL_SF); the others run and return rows."""

import pytest

from siftmill.plans.registry import load_all
from tests import oracle

CATALOG = load_all()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(oracle.sf())


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    q = CATALOG[name]
    got = q.build(spark, oracle.sf()).toPandas()
    if q.sql is None:
        assert len(got.columns) > 0
    else:
        assert oracle.compare(got, con.execute(q.sql).df()) is None


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    rest = entry.llm_queries.QUERIES.keys() | {"pipeline"} if entry.llm_queries else set()
    assert entry.queries().keys() == CATALOG.keys() | rest
