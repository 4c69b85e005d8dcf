"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, con, name):
    n, differing, note = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert differing == 0, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pr_id", "path", "line_no", "rule_id", "message", "suppressed"] and df.count() > 0


def test_flagship_stays_in_the_jvm(spark):
    plan = entry.entry(spark)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
