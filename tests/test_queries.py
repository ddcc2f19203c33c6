"""Every registered query runs; those with check SQL agree with it."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from pagetide import plans

QUERIES, ORACLES = plans.load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
