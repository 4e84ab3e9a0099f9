"""Every registered sonar query against its DuckDB equivalent; those without one run and have rows."""

import pytest

from soundings.plans import catalog

from compare import connect, same

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con(middle):
    return connect(middle)


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalog.oracle_sql()])
def test_equals_sql(spark, middle, con, name):
    same(catalog.queries()[name](spark, middle), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in catalog.oracle_sql()])
def test_runs(spark, middle, name):
    assert catalog.queries()[name](spark, middle).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
