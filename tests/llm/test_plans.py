import re

import pytest

from marlstone.llm import common, queries


@pytest.mark.parametrize("name", ["op4_license_scan", "op6_url_filter"])
def test_native_queries_run_no_python(spark, small, name):
    p = queries.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|RDD|CartesianProduct|BroadcastNestedLoopJoin", p)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_cross_joins(spark, small, name):
    p = queries.queries()[name](spark, small)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_written_tables_end_a_lineage(spark):
    p = common.written(spark.range(5).withColumnRenamed("id", "x"))._jdf.queryExecution().toString()
    assert "Range" not in p and "parquet" in p
