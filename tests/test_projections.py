import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import event
from spanlake.sources.events import write_metric_snapshot, write_projections
from spanlake.tables import Tables


def files(root, name):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/{name}") for f in names if f.endswith(".parquet")}


def test_projections_in_key_buckets(spark, tables, tmp_path):
    root = str(tmp_path / "tables")
    calls = [event(i, "tool.completed", i, {"toolCallId": f"c{i}", "runId": "r", "durationMs": i}) for i in range(60)]
    before = tables(calls)
    write_projections({n: before.get(n) for n in ("tool_calls", "agent_runs")}, root)
    read = Tables(spark, root=root)
    assert read.tool_calls.columns == before.tool_calls.columns and read.tool_calls.count() == 60 and read.agent_runs.count() == 0
    found = read.row("tool_calls", "local-test", "c7")
    assert [r.duration_ms for r in found.collect()] == [7.0] and read.row("tool_calls", "local-test", "none").count() == 0
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: .*key_bucket#\d+ = \d+", plan), [x for x in plan.splitlines() if "Filter" in x]  # other folders are not read
    assert before.row("tool_calls", "local-test", "c7").count() == 1
    with pytest.raises(ValueError):
        read.row("tool_calls", "c7")
    old = files(root, "tool_calls")
    after = tables(calls + [event(100, "tool.failed", 90, {"toolCallId": "c7", "durationMs": 70}), event(101, "tool.completed", 90, {"toolCallId": "new", "durationMs": 1})])
    changed = after.tool_calls.where("tool_call_id in ('c7', 'new')").select("instance_id", "tool_call_id")
    write_projections({"tool_calls": after.tool_calls, "agent_runs": after.agent_runs}, root, {"tool_calls": changed})
    again = Tables(spark, root=root)
    assert again.tool_calls.count() == 61 and again.row("tool_calls", "local-test", "c7").collect()[0].status == "failed"
    assert sorted(map(str, again.tool_calls.collect())) == sorted(map(str, after.tool_calls.collect()))
    kept = old & files(root, "tool_calls")
    assert len({os.path.dirname(f) for f in old - kept}) <= 2 and kept


def test_metric_snapshots_are_appended(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = spark.range(3).select(F.lit("2026-01-01").cast("timestamp").alias("ts"), F.concat(F.lit("m"), F.col("id") % 2).alias("metric"), F.create_map(F.lit("a"), F.lit("b")).alias("labels"), F.col("id").cast("double").alias("value"))
    write_metric_snapshot(rows, path)
    write_metric_snapshot(rows, path)
    assert sorted((r.metric, r.value) for r in spark.read.parquet(path).collect()) == [("m0", 0.0), ("m0", 0.0), ("m0", 2.0), ("m0", 2.0), ("m1", 1.0), ("m1", 1.0)]
