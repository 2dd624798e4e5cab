from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry
from folianth.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no fixtures")


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_as_sql(spark, name):
    n, bad = oracle.compare(spark, plans.QUERIES[name], plans.ORACLE[name], SF)
    assert n and not bad


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
