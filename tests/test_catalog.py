"""Every query of the library against its SQL."""

from __future__ import annotations

import pytest
from compare import same

from quarry.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    assert same(catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["s"]
    assert set(e.oracle_sql()) <= set(e.queries())
