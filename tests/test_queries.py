import oracle
import pytest

import __spark_entry__ as entry

from tidewell.plans.queries import ORACLE as SQL  # noqa: E402
from tidewell.plans.queries import QUERIES  # noqa: E402

NAMES = list(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, name):
    found = oracle.rows_of_spark(entry.queries()[name](spark, sf))
    if name in SQL:
        assert found == oracle.rows_of_sql(SQL[name], sf)
    else:
        assert found[1]
        if "same" in found[0]:
            assert all(r[found[0].index("same")] for r in found[1])


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
