"""Every registered query against its reference SQL, and what its plan must not contain."""

import pytest

from __spark_entry__ import entry
from check import compare, oracle
from tests.conftest import SF
from tidemark.plans.catalog import oracle_sql, queries

GLOBAL_AGGREGATE = {"needs_full_backup", "cadence_overdue"}  # the newest instant of the log, one row


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("name", queries())
def test_query(spark, duck, name):
    assert compare(spark, duck, name, SF).startswith("ok")


@pytest.mark.parametrize("name", queries())
def test_plan(spark, name, capsys):
    queries()[name](spark, SF).explain()
    plan = capsys.readouterr().out
    banned = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]
    if name not in GLOBAL_AGGREGATE:
        banned.append("SinglePartition")
    assert not [b for b in banned if b in plan]


def test_entry(spark):
    assert entry(spark).columns == ["key", "image"]
    assert entry(spark).count() > 0
