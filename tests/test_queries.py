"""Every query against its SQL on the smallest tables; those without SQL must run."""

from pathlib import Path

import oracle
import pytest

from trajloom.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_of_the_sql(spark, name):
    assert oracle.differences(spark, DATA, queries.queries()[name], queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
