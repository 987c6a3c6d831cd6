"""The metric snapshot as one long table (metric, labels, value), by family."""

from __future__ import annotations

from functools import reduce as _fold

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..tables import Tables
from .attribution import Measure, llm_named, rolled_up
from .filters import Filters, blank_to, instant
from .lists import queue_depths
from .reduce import payload_text

# fixed values: resource columns and the metric each one feeds
RESOURCES = {
    "cpu_seconds_total": "process_cpu_seconds_total", "resident_memory_bytes": "process_resident_memory_bytes",
    "virtual_memory_bytes": "process_virtual_memory_bytes", "threads": "process_threads", "open_fds": "process_open_fds",
    "read_bytes": "process_read_bytes_total", "write_bytes": "process_write_bytes_total",
    "disk_total_bytes": "host_disk_total_bytes", "disk_available_bytes": "host_disk_available_bytes",
}


def metric(df: DataFrame, name: str | Column, value: str | Column, labels: dict[str, str | Column]) -> DataFrame:
    pairs = [x for k, v in labels.items() for x in (F.lit(k), F.col(v) if isinstance(v, str) else v)]
    value = F.col(value) if isinstance(value, str) else value
    return df.select((F.lit(name) if isinstance(name, str) else name).alias("metric"), F.create_map(*pairs).alias("labels"), value.cast("double").alias("value"))


def union(*parts: DataFrame) -> DataFrame:
    return _fold(DataFrame.unionByName, parts)


def gateway(t: Tables, now: str | None = None) -> DataFrame:
    clock = instant(now) if now else F.current_timestamp()
    by = {"instance": "instance_id"}
    uptime = F.greatest(F.lit(0), F.unix_seconds(clock) - F.unix_seconds("started_at"))
    starts = t.ledger.where("event_type = 'gateway.started'").groupBy("instance_id").agg(F.count("*").alias("n"))
    return union(metric(t.instances, "gateway_up", F.when(F.col("status") == "up", 1).otherwise(0), by),
                 metric(t.instances.where("started_at is not null"), "gateway_uptime_seconds", uptime, by),
                 metric(starts, "gateway_restarts_total", F.greatest(F.col("n") - 1, F.lit(0)), by))


def active(t: Tables) -> DataFrame:
    def one(df: DataFrame, name: str) -> DataFrame:
        return metric(df.where("status = 'active'").groupBy("instance_id").agg(F.count("*").alias("n")), name, "n", {"instance": "instance_id"})
    return union(one(t.sessions, "sessions_active"), one(t.agent_runs, "agent_runs_active"))


def runs(t: Tables) -> DataFrame:
    return metric(t.agent_runs.groupBy("instance_id", "status").agg(F.count("*").alias("n")), "agent_runs_total", "n", {"instance": "instance_id", "status": "status"})


def llm(t: Tables) -> DataFrame:
    """One pass by status; tokens and cost are summed again over the statuses."""
    dims = ["instance_id", "provider", "model"]
    by = {"instance": "instance_id", "provider": "provider", "model": "model"}
    rows = llm_named(t.llm_calls).groupBy(*dims, "status").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("cost_usd").alias("c"))
    sums = rows.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in "ioc"])
    return union(metric(rows, "llm_requests_total", "n", {**by, "status": "status"}),
                 metric(sums, "llm_tokens_total", "i", {**by, "direction": F.lit("input")}), metric(sums, "llm_tokens_total", "o", {**by, "direction": F.lit("output")}),
                 metric(sums, "llm_cost_usd_total", "c", by))


def tools(t: Tables) -> DataFrame:
    calls = t.tool_calls.withColumn("tool", blank_to("tool_name")).withColumn("reason", blank_to("error_category"))
    totals = calls.groupBy("instance_id", "tool", "status").agg(F.count("*").alias("n"))
    failed = calls.where("status = 'failed'").groupBy("instance_id", "tool", "reason").agg(F.count("*").alias("n"))
    return union(metric(totals, "tool_calls_total", "n", {"instance": "instance_id", "tool": "tool", "status": "status"}),
                 metric(failed, "tool_errors_total", "n", {"instance": "instance_id", "tool": "tool", "reason": "reason"}))


def events(t: Tables) -> DataFrame:
    received = t.ledger.groupBy("instance_id", "event_type").agg(F.count("*").alias("n"))
    p = F.try_parse_json("payload")
    drops = t.ledger.where("event_type = 'monitor.events_dropped'").select(
        "instance_id", F.coalesce(F.nullif(payload_text("reason"), F.lit("")), F.lit("unknown")).alias("reason"),
        F.coalesce(F.try_variant_get(p, "$.count", "double"), F.lit(1.0)).alias("n"))
    dropped = drops.groupBy("instance_id", "reason").agg(F.sum("n").alias("n"))
    return union(metric(received, "monitor_events_received_total", "n", {"instance": "instance_id", "event_type": "event_type"}),
                 metric(dropped, "monitor_events_dropped_total", "n", {"instance": "instance_id", "reason": "reason"}))


def queue(t: Tables) -> DataFrame:
    return metric(queue_depths(t), "monitor_event_queue_depth", "queue_depth", {"instance": "instance_id"})


def agent_model(t: Tables) -> DataFrame:
    sums = rolled_up(llm_named(t.llm_calls), t, Filters(), ["model"], [
        Measure("tokens", "input_tokens + output_tokens + cache_read_tokens + cache_write_tokens"), Measure("cost", "cost_usd")], by_agent=True)
    by = {"agentId": "agent_id", "model": "model"}
    return union(metric(sums, "llm_tokens_by_agent_model", "tokens", by), metric(sums, "llm_cost_by_agent_model", "cost", by))


def resources(t: Tables) -> DataFrame:
    """The latest sample of each instance, one row per value."""
    last = t.resource_samples.groupBy("instance_id").agg(F.max(F.struct("sampled_at", "event_id", *RESOURCES)).alias("s"))
    values = F.array(*[F.struct(F.lit(name).alias("metric"), F.col("s." + c).cast("double").alias("value")) for c, name in RESOURCES.items()])
    rows = last.select("instance_id", F.inline(values))
    return metric(rows, F.col("metric"), "value", {"instance": "instance_id"})


FAMILIES = {"gateway": gateway, "active": active, "runs": runs, "llm": llm, "tools": tools, "events": events, "queue": queue,
            "agent_model": agent_model, "resources": resources}


def metric_snapshot(t: Tables, now: str | None = None, prefix: str = "") -> DataFrame:
    clock = instant(now) if now else F.current_timestamp()
    parts = [fn(t, now) if fn is gateway else fn(t) for fn in FAMILIES.values()]
    return union(*parts).select(clock.alias("ts"), F.concat(F.lit(prefix), "metric").alias("metric"), "labels", "value")


def cap_labels(samples: DataFrame, label: str, keep: int, metric_name: str) -> DataFrame:
    """One metric with its ``keep`` greatest label values; the others are added up as ``other``."""
    rows = samples.where(F.col("metric") == metric_name).withColumn("_l", F.col("labels")[label])
    top = rows.groupBy("_l").agg(F.sum("value").alias("_v")).orderBy(F.desc("_v"), "_l").limit(keep).select("_l", F.lit(True).alias("_top"))
    return (rows.join(top, "_l", "left").groupBy(F.when(F.col("_top"), F.col("_l")).otherwise("other").alias(label))
            .agg(F.sum("value").alias("value")).select(F.lit(metric_name).alias("metric"), label, "value"))
