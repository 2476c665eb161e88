"""The shape of physical plans: scans, shuffles, pushdown, nothing in Python."""

import re

import pytest

from tideline.operators.variation import (
    lag_variation,
    rolling_weekday_baseline,
    variation_vs_recent,
)
from tideline.plans import all_queries
from tideline.plans.tables import shipments


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern, text):
    return len(re.findall(pattern, text))


@pytest.fixture(scope="module", autouse=True)
def whole_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize(
    "name,scans,exchanges,sorts",
    [
        ("shipments_per_day", 1, 1, 0),
        ("rolling_baseline", 1, 2, 1),
        ("rolling_baseline_by_supplier", 1, 2, 1),
        ("yoy_variation", 1, 2, 1),
        ("both_methods_one_pass", 1, 2, 1),
        ("yoy_vs_recent_weeks", 1, 2, 1),
        ("position_by_supplier", 1, 2, 2),
        ("filled_gaps", 1, 2, 1),
        ("gate_series", 1, 3, 0),
    ],
)
def test_scans_and_shuffles(spark, sf_dir, name, scans, exchanges, sorts):
    text = plan(all_queries()[name](spark, sf_dir))
    assert count("FileScan", text) == scans
    assert count(r"- Exchange", text) == exchanges
    assert count(r"- Sort ", text) == sorts
    # The roll-up combines before its shuffle.
    assert "partial_" in text


@pytest.mark.parametrize("frame", ["rows", "calendar"])
def test_three_comparisons_share_one_shuffle_and_sort(spark, sf_dir, frame):
    keys, metrics = ["l_suppkey"], ["quantity", "value"]
    series = rolling_weekday_baseline(
        shipments(spark, sf_dir, keys), metrics, keys, frame=frame
    )
    series = lag_variation(series, metrics, keys)
    text = plan(variation_vs_recent(series, "value_yoy_pct", keys, frame=frame))
    assert count(r"- Window ", text) == 3
    assert (count(r"- Exchange", text), count(r"- Sort ", text)) == (2, 1)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_python_and_no_pairing(spark, sf_dir, name):
    text = plan(all_queries()[name](spark, sf_dir))
    for unwanted in ("Python", "Pandas", "Cartesian", "NestedLoop"):
        assert unwanted not in text


def test_period_reaches_the_scan(spark, sf_dir):
    text = plan(all_queries()["rolling_baseline_recent"](spark, sf_dir))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: (.*)", text)
    assert "GreaterThanOrEqual(l_shipdate,2001-06-02" in pushed.group(1)
    assert pushed.group(2).startswith("struct<l_extendedprice:double,l_shipdate:timestamp_ntz>")


def test_history_reaches_the_scan(spark, sf_dir):
    text = plan(all_queries()["position_in_history_yoy"](spark, sf_dir))
    assert "GreaterThanOrEqual(l_shipdate,1998-07-01" in text


@pytest.fixture
def whole_plan(spark, sf_dir):
    """The plan of a query with its reused shuffles. With adaptive execution, reuse shows only in what has run."""

    def of(name):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return plan(all_queries()[name](spark, sf_dir))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    return of


@pytest.mark.parametrize("name", ["baseline_integrity", "yoy_integrity", "same_date_integrity"])
def test_parity_costs_no_second_scan(whole_plan, name):
    text = whole_plan(name)
    assert (count("FileScan", text), count("ReusedExchange", text)) == (1, 1)


@pytest.mark.parametrize("name", ["distribution_by_year", "distribution_across_suppliers", "distribution_by_weekday"])
def test_counted_values_are_shuffled_once(whole_plan, name):
    text = whole_plan(name)
    assert (count("FileScan", text), count("ReusedExchange", text)) == (1, 1)


@pytest.mark.parametrize("name", ["gate_gaps", "gate_gaps_by_supplier"])
def test_gaps_fold_to_days_once(spark, sf_dir, name):
    """Before the roll-up's shuffle and after it; every further fold by day holds all groups of a task again."""
    text = plan(all_queries()[name](spark, sf_dir))
    assert count(r"HashAggregate\(keys=\[[^\]]*(?:day|_groupingexpression)#", text) == 2


def test_percentiles_hold_no_group(spark, sf_dir):
    text = plan(all_queries()["distribution_across_suppliers"](spark, sf_dir))
    assert "percentile" not in text and "ObjectHashAggregate" not in text


@pytest.mark.parametrize(
    "name,since",
    [
        ("published_vs_calculated", "2001-06-02"),
        ("ext_period_total", "2001-06-02"),
        ("yoy_vs_recent_targets", "2000-06-03"),
        ("position_in_history", "1999-06-02"),
        ("position_in_history_value", "1999-06-02"),
        ("weekend_drops", "1999-06-02"),
        ("distribution_by_weekday", "2000-06-02"),
        ("ext_position_in_month", "1999-06-02"),
        ("ext_window_sensitivity", "1996-06-02"),
        ("side_by_side", "2000-07-01"),
    ],
)
def test_proven_look_backs_reach_the_scan(whole_plan, name, since):
    text = whole_plan(name)
    assert count("FileScan", text) == 1
    assert f"GreaterThanOrEqual(l_shipdate,{since}" in re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)


def test_holidays_by_rule_cost_no_scan(spark, sf_dir):
    assert count("FileScan", plan(all_queries()["ext_business_days"](spark, sf_dir))) == 1
