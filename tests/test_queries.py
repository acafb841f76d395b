"""Every registered query of the library against its SQL on the smallest tables."""

import pytest
from compare import of_duck, of_spark
from conftest import SF
from siltstone import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = of_spark(QUERIES[name](spark, SF))
    if name in ORACLES:
        assert got == of_duck(duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
