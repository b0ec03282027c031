"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from verbena.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_agrees_with_sql(spark, con, sf_dir, frame, name):
    good, note = compare(spark, con, sf_dir, lambda *_: frame(name), entry.oracle_sql()[name])
    assert good, note


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() == 2
