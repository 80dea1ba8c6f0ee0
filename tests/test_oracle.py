"""Every query with an SQL twin, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from workload.check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
#: The text operators and the pipeline are compared in tests of their own.
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name != "pipeline" and not name.startswith("op")}
PLAIN = sorted(name for name in QUERIES if name not in ORACLES and name != "pipeline" and not name.startswith("op"))


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    ok, message = compare(spark, duck, SF, name, QUERIES[name], ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", PLAIN)
def test_runs_without_sql(spark, name):
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()


def test_something_is_compared():
    assert len(ORACLES) > 160 and len(PLAIN) < 20


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
