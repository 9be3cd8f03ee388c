"""What the physical plans must and must not contain."""

import os
import re

import pytest

from tallyfield import plans

SF = "/root/testdata/sf0.001"
REGISTRY = plans.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(spark, name):
    df = REGISTRY[name].run(spark, SF)
    return df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["rfm", "calibration_holdout", "make_features",
                                  "inactivity_rule_economics"])
def test_date_filter_reaches_the_scan(spark, name):
    text = plan(spark, name)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", text)
    assert "o_orderpriority" not in text and "o_orderstatus" not in text


def test_rules_are_counted_in_one_scan(spark):
    text = plan(spark, "inactivity_rule_economics")
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) == 1


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.area in (
    "purchases", "cleaning", "experiments", "attribution", "policy", "uplift", "dml", "quality")
    and n not in ("cross_fit_logistic", "uplift_learners")][::4])
def test_no_cartesian_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_duplicates_are_joined_on_the_line_id(spark):
    assert re.search(r"Left keys \[1\]: \[line_id", plan(spark, "flag_lines"))
