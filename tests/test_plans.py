"""What the plans look like: pushed filters, pruned columns, shuffles, joins."""

import re

import pytest

from etlspec import existence, snapshot_diff
from etlspec.catalogue import CATALOGUE
from tests.conftest import SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, name: str) -> str:
    return plan_of(CATALOGUE[name].run(spark, SMALL))


def count(text: str, node: str) -> int:
    return len(re.findall(rf"(?<!\w){node}\b", text))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "pipe_flagship")
    assert "GreaterThan(o_totalprice,0.0)" in text and "EqualTo(o_orderstatus,F)" in text
    assert "o_orderpriority" not in text and "Exchange" not in text


def test_sql_text_conditions_push_down_as_well(spark):
    text = plan(spark, "trn_filter_sqltext")
    assert "GreaterThanOrEqual(l_quantity,25.0)" in text and "In(l_returnflag, [A,R])" in text


def test_join_prunes_columns(spark):
    text = plan(spark, "trn_join_inner")
    for unused in ("o_totalprice", "l_comment", "l_extendedprice"):
        assert unused not in text


@pytest.mark.parametrize("name", ["pii_all", "pii_report", "ra_check_rows", "ra_fingerprint", "udf_body", "src_api"])
def test_no_python_worker_in_the_built_in_paths(spark, name):
    if name != "src_api":
        assert "Python" not in plan(spark, name)


@pytest.mark.parametrize("name", ["pii_all", "ra_check_rows", "ra_fingerprint", "trn_filter", "trn_rename_swap"])
def test_row_local_operators_do_not_shuffle(spark, name):
    assert count(plan(spark, name), "Exchange") == 0


@pytest.mark.parametrize("name", ["ra_snapshot_diff", "ra_snapshot_diff_changes", "ra_overlay", "ra_existence", "trn_aggregate"])
def test_one_shuffle_and_no_join(spark, name):
    text = plan(spark, name)
    assert count(text, "Exchange") == 1 and "Join" not in text


def test_diff_without_detail_shuffles_digests_only(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    text = plan_of(snapshot_diff(orders, orders, ["o_orderkey"], detail=False))
    exchange = text[text.index("Exchange") :].splitlines()[2:4]
    assert any("sha2" in line for line in exchange)


def test_aggregates_combine_before_the_shuffle(spark):
    text = plan(spark, "trn_aggregate_multi")
    assert text.index("partial_count") > text.index("Exchange")


def test_existence_combines_before_the_shuffle(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_custkey")
    text = plan_of(existence(orders, orders, ["o_custkey"]))
    assert count(text, "HashAggregate") == 2


def test_partition_total_aggregates_instead_of_a_window(spark):
    text = plan(spark, "trn_window_partition_total")
    assert "Window" not in text and "partial_sum" in text


def test_duplicate_texts_are_counted_by_digest(spark):
    text = plan(spark, "ra_duplicates")
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning(" in line]
    assert shuffles and not any("text" in line for line in shuffles)


def test_nothing_broadcasts_or_crosses_by_hint(spark):
    for name in ("trn_join_inner", "pipe_join_chain", "ra_orphans_orders", "sql_range_join"):
        text = plan(spark, name)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_duplicates_scan_the_table_for_counts_and_for_texts(spark):
    df = CATALOGUE["ra_duplicates"].run(spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 2
