"""Every registered query of the library beside its SQL, on the smallest tables; those without SQL must give rows."""

import pytest

from perilens import catalogue
from tests.oracle import connect, difference

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DIR)
    text = catalogue.oracle_sql().get(name)
    if text:
        assert difference(df, con, text) == ""
    else:
        assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
