import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "rank", "keyword", "n"] and df.count() > 0
