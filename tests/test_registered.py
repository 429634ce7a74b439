"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as registry
from check_oracles import compare, duck
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

FORBIDDEN = re.compile(r"EvalPython|MapInPandas|FlatMapGroups|CartesianProduct|BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(registry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    """Rows as its SQL has them, from a plan that stays in the JVM and joins on keys; jobs too, whose frames end in tables."""

    def look(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not FORBIDDEN.search(plan), plan

    ok, line = compare(spark, con, SF_DIR, name, look)
    assert ok, line


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["position", "verdict", "cnt"] and df.count() == 7
