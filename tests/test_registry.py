"""Every query that SQL can state gives SQL's rows; the others run."""

import pytest

from loam import registry
from tests.oracle import same

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql:
        same(spark, sf, query, sql)
    else:
        assert query(spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["id", "title", "content", "original_group_count"]
    assert out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
