"""Every registered query against its SQL on the smallest tables; those without SQL must give rows."""

import pytest

from marginalia.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0 and len(set(got.columns)) == len(got.columns)
    if name in registry.ORACLES:
        oracle.compare(got, oracle.expected(registry.ORACLES[name], SF))


@pytest.mark.parametrize("name", sorted(registry.EXAMPLES))
def test_example(spark, name):
    run, sql = registry.EXAMPLES[name]
    assert name in registry.QUERIES
    oracle.compare(run(spark, SF).toPandas(), oracle.expected(sql, SF))


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "norm", "n", "first_start", "item_id", "rank"]
