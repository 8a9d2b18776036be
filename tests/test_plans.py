"""Plan properties that matter at scale: pruning and pushdown reach the scan,
no cartesian products, no row-at-a-time Python in batch queries."""

import pytest

from conftest import SF_SMALL
from tidepool.plans.catalog import QUERIES
from tidepool.plans import fixtures as FX
from tidepool.session import scratch_dir
from tidepool.sources import history as H


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_read_prunes_partitions_and_pushes_filters(spark):
    path = scratch_dir(spark, "test-pruning")
    H.write_measurements(FX.readings(spark, SF_SMALL), path, mode="overwrite")
    h = H.read_history(spark, path, "3", "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    plan = _plan(h.select("seq", "value"))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "PartitionFilters: [isnotnull(day" in scan and "(day#" in scan      # partition pruning
    assert "PushedFilters: [" in scan and "GreaterThanOrEqual(ts" in scan       # time range pushed
    assert "IsNotNull(device_id)" in scan                                        # device filter pushed
    assert "ReadSchema: struct<device_id:string,value:double,ts:timestamp,seq:bigint>" in scan


BATCH = sorted(k for k in QUERIES if not k.startswith("stream_")
               and k not in ("history_range", "metrics_table", "subscription_file"))


@pytest.mark.parametrize("name", BATCH)
def test_no_cartesian_or_python_rows(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def _initial(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize(("name", "scans"), [("batch_status", 1), ("clean_readings", 1), ("type_counts", 1), ("retention", 3),
                                             ("retention_report", 10)])
def test_scans(spark, name, scans):
    assert _initial(QUERIES[name](spark, SF_SMALL)).count("FileScan parquet") <= scans


def test_top_k_is_cut_before_the_shuffle(spark):
    for name in ("last_100", "type_sample"):
        assert "WindowGroupLimit" in _plan(QUERIES[name](spark, SF_SMALL)), name


def test_stream_and_write_queries_plan_without_nested_loops(spark):
    for name in ("history_range", "metrics_table", "subscription_file", "stream_flush", "stream_presence", "stream_atomic_write"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_hot_type_and_hour_is_spread(spark):
    """Readings of one type in one hour: the type-level pass puts them in many buckets."""
    from pyspark.sql import functions as F

    from tidepool.operators.validate import TYPE_BUCKET_SECONDS
    from tidepool.plans.windows import time_bucket

    hour = spark.range(3600).select(F.timestamp_seconds(F.col("id") + 1704067200).alias("ts"))
    assert hour.select(time_bucket("ts", TYPE_BUCKET_SECONDS)).distinct().count() == 60


def test_gate_does_not_shuffle_readings(spark):
    plan = _plan(QUERIES["subscription_gate"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # exchanges stand below the broadcast side only
    left = plan.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in left
