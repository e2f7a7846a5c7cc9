"""Every registered query against its SQL, and the shape of its plan."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from queries.catalogue import ORACLES, QUERIES
from tools.compare import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() == 20


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    columns, mine = spark_rows(df)
    names, theirs = sql_rows(con, oracle_sql()[name])
    assert columns == names
    assert mine == theirs
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("role_counts", "conv_id:bigint,role:string"),
        ("length_anomaly", "text:string,source:string"),
        ("presence_checks", "doc_id:bigint"),
        ("manifest_file_rows", "doc_id:bigint,text:string,n_chars:bigint"),
    ],
)
def test_scans_read_only_what_they_need(spark, name, columns):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schemas = {line.split("ReadSchema: struct<")[1].split(">")[0] for line in plan.split("\n") if "ReadSchema" in line}
    assert schemas
    for schema in schemas:
        assert set(schema.split(",")) <= set(columns.split(","))


def test_texts_are_searched_without_a_shuffle(spark):
    plan = queries()["trigger_patterns"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
