"""Shape of the physical plans."""

import os
import re

import pytest

from skyloom.plans import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().treeString()


@pytest.mark.parametrize("name", [
    "flt2_all_positive", "bin1_equal_width", "sca2_standard_population", "win1_rebase", "ts2_normalise_curve", "agg8_box_summary",
    "clu5_cluster_class_lift", "evl1_confusion_matrix", "ml1_naive_bayes_confusion", "bin2_histogram_sum", "jn10_param_grid",
    "smp3_with_replacement", "ts10_gaussian_smooth", "ts8_monte_carlo_curves", "arm5_recommend"])
def test_no_cross_joins(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = QUERIES["flt2_all_positive"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(l_quantity,0.0)" in text and "GreaterThan(l_tax,0.0)" in text and "l_comment" not in text
    line = QUERIES["clu5_cluster_class_lift"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_linenumber:int,l_returnflag:string>" in line


def test_top_n_per_class_is_limited_before_the_shuffle(spark):
    text = plan(spark, "smp4_per_class")
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_mask_and_row_local_work_do_not_shuffle(spark):
    for name in ("flt2_all_positive", "cln1_repair_sizes", "scl1_math", "gen1_uniform_design", "smp5_split"):
        assert "Exchange" not in plan(spark, name)


def test_ordered_work_moves_the_table_once(spark):
    from skyloom.operators.ordering import ordered

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).selectExpr("id % 3 AS k", "CAST(id AS double) AS t", "id AS wide")
        text = ordered(df, ["k"], "t", cell=10.0, previous=["wide"], index="i")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the table, its summaries by cell, their running totals by series, and the way back to the cells
    assert text.count("Exchange hashpartitioning") <= 4 and text.count("Window [") <= 2
