"""The physical plans that make the operators hold at scale."""

import re

import pytest

from tiffin.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
# Streams and published batches: what they return only reads what they wrote.
WRITTEN = [name for name in QUERIES if name.endswith(("_stream", "_keyed")) or name.startswith("place_orders_")]


@pytest.fixture
def plan(spark):
    """Plan text with every table too large for an automatic broadcast."""

    def text(name_or_df):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            df = QUERIES[name_or_df](spark, FOLDER) if isinstance(name_or_df, str) else name_or_df
            return df._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    return text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(WRITTEN)))
def test_no_nested_loops_and_no_python(plan, name):
    text = plan(name)
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    assert not any(node in text for node in PYTHON_NODES)


@pytest.mark.parametrize("name", ["menu_catalog", "recent_orders", "order_lines_flat", "price_orders_valid", "cart_state_batch"])
def test_only_counted_tables_are_broadcast(plan, name):
    """Of the model tables, only the categories (from p_brand) are marked for broadcast."""
    for broadcast in plan(name).split("BroadcastExchange")[1:]:
        assert "p_brand" in broadcast


def test_pages_are_top_n(plan):
    assert "TakeOrderedAndProject(limit=60" in plan("order_page")
    assert plan("order_pages").count("WindowGroupLimit") == 2  # partial before the shuffle, final after it


def test_window_rows_share_one_shuffle(spark):
    df = QUERIES["status_anomalies"](spark, FOLDER)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_day_filter_reaches_the_scan(plan):
    text = plan("completed_on_day")
    assert "PushedFilters" in text and "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_scans_read_only_needed_columns(plan):
    text = plan("top_selling")
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_extendedprice:double>", text)
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in text


def test_single_distinct_is_not_expanded(plan):
    assert "Expand" not in plan("daily_sales") and "Expand" not in plan("top_selling")


def test_constraints_share_scans_and_shuffles(spark):
    """Each table is read once for its rules and keys, and once more if it has names; keys and names take a shuffle each."""
    df = QUERIES["constraint_report"](spark, FOLDER)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert text.count("FileScan parquet") <= 8 + 1  # categories come out of the items, and are made distinct
    assert len(re.findall(r"Exchange hashpartitioning\((owner|place)#\d+, (number|name)#", text)) == 2
