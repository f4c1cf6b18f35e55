"""Plans: one scan of the line items per query, no Python, no cartesian product, nothing run while a query is built."""

import re

import pytest

from equiflow.plans import registry
from tests.conftest import SF_SMALL

QUERIES = registry.queries()
ONE_SCAN = ["fundamental_ratios", "dcf_summary", "statement_pivot", "suffix_join", "sma", "rsi", "macd", "technical_indicators", "trailing_year_prices", "wacc", "price_action"]
#: These write and read back, or count columns: their feature is an action.
EAGER = {"chunk_stream", "chunk_stream_counts", "event_sessions", "table_profile", "with_row_id", "lineitem_row_id", "supplier_row_id", "positional_slice", "isolated_run", "sink_roundtrip", "csv_roundtrip", "text_json_sink", "drop_all_null_columns"}


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_line_items_are_scanned_once(spark, name):
    plan = final_plan(QUERIES[name](spark, SF_SMALL))
    assert len(re.findall(r"FileScan parquet [^\n]*l_suppkey", plan)) == 1


def test_html_needs_no_shuffle(spark):
    assert "Exchange" not in final_plan(QUERIES["to_html_rows"](spark, SF_SMALL))


def test_a_sector_is_not_one_task(spark):
    plan = final_plan(QUERIES["factor_score"](spark, SF_SMALL))
    assert "SinglePartition" not in plan and "percent_rank" not in plan


def test_no_python_and_no_cartesian_product(spark):
    for name in sorted(set(QUERIES) - EAGER):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan), name


def test_building_a_query_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    try:
        for name in sorted(set(QUERIES) - EAGER):
            QUERIES[name](spark, SF_SMALL)
            jobs = [j for j in tracker.getJobIdsForGroup("building")]
            # reading a parquet footer for its schema is a job of one task
            assert all(len(tracker.getJobInfo(j).stageIds) == 1 and tracker.getStageInfo(tracker.getJobInfo(j).stageIds[0]).numTasks == 1 for j in jobs), name
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
