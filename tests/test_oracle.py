"""Every library query that has SQL gives the same rows at the smallest scale."""

import pytest

from moodtide.plans.queries import ORACLE, QUERIES
from tests.oracle import rows_of, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == sql_rows(ORACLE[name], FOLDER)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
