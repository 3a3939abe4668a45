"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

from __future__ import annotations

import oracle
import pytest

from tidemark.plans import registry as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, con, name):
    assert oracle.difference(plans.QUERIES[name](spark, SF), con, plans.ORACLES[name]) is None


def test_contract(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert entry.entry(spark).count() > 0
