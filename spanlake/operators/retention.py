"""Rollups of samples, daily statistics, retention and back-pressure edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce as _fold

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import previous, time_slice
from ..tables import Tables
from .attribution import llm_named, run_agents, tool_events
from .filters import instant
from .reduce import payload_number
from .stats import count
from .timeseries import bucket_of

# fixed values: age limits of the sample tiers and their bucket in seconds
TIERS = ((3600, None), (86400, 60), (30 * 86400, 900), (None, 86400))
SATURATED = 0.8


def rollup_samples(samples: DataFrame, seconds: int) -> DataFrame:
    """One row per process and bucket: means, peaks and the last counter values."""
    last = ("cpu_seconds_total", "read_bytes", "write_bytes", "disk_total_bytes", "disk_available_bytes")
    mean = ("resident_memory_bytes", "virtual_memory_bytes", "threads", "open_fds")
    return (samples.groupBy("instance_id", "process_id", bucket_of("sampled_at", seconds).alias("bucket"))
            .agg(F.count("*").alias("samples"), *[F.avg(c).alias(c) for c in mean], F.max("resident_memory_bytes").alias("max_resident_memory_bytes"),
                 F.max(F.struct("sampled_at", "event_id", *last)).alias("_last"))
            .select("instance_id", "process_id", "bucket", "samples", *mean, "max_resident_memory_bytes", *[F.col("_last." + c).alias(c) for c in last]))


def tiered_rollup(samples: DataFrame, now: str) -> DataFrame:
    """Samples at the resolution their age calls for: as they are, per minute, per quarter hour, per day."""
    age = F.unix_seconds(instant(now)) - F.unix_seconds("sampled_at")
    parts, low = [], None
    for high, seconds in TIERS:
        tier = samples
        if low is not None:
            tier = tier.where(age >= low)
        if high is not None:
            tier = tier.where(age < high)
        if seconds is None:
            out = tier.select("instance_id", "process_id", F.col("sampled_at").alias("bucket"), F.lit(1).cast("bigint").alias("samples"),
                              *[F.col(c).cast("double").alias(c) for c in ("resident_memory_bytes", "virtual_memory_bytes", "threads", "open_fds")],
                              F.col("resident_memory_bytes").alias("max_resident_memory_bytes"), "cpu_seconds_total", "read_bytes", "write_bytes", "disk_total_bytes", "disk_available_bytes")
        else:
            out = rollup_samples(tier, seconds)
        parts.append(out.withColumn("resolution", F.lit(seconds or 0)))
        low = high
    return _fold(DataFrame.unionByName, parts)


def daily_stats(t: Tables) -> DataFrame:
    """(day, instance, dimension, value, requests, errors, tokens, cost) by agent, model and tool."""
    def day(column: str) -> Column:
        return F.date_format(column, "yyyy-MM-dd")

    runs = run_agents(t).groupBy(day("started_at").alias("day"), "instance_id", F.col("agent_id").alias("dimension_value")).agg(
        F.count("*").alias("requests"), count("status = 'failed'").alias("errors")).withColumn("dimension_type", F.lit("agent"))
    tokens = F.expr("input_tokens + output_tokens + cache_read_tokens + cache_write_tokens")
    models = llm_named(t.llm_calls).groupBy(day("started_at").alias("day"), "instance_id", F.concat("provider", F.lit("/"), "model").alias("dimension_value")).agg(
        F.count("*").alias("requests"), count("status = 'failed'").alias("errors"), F.sum(tokens).alias("tokens"), F.sum("cost_usd").cast("double").alias("costUsd")).withColumn("dimension_type", F.lit("model"))
    tools = tool_events(t).groupBy(day("started_at").alias("day"), "instance_id", F.concat("source", F.lit(":"), "tool").alias("dimension_value")).agg(
        F.count("*").alias("requests"), count("status = 'failed'").alias("errors")).withColumn("dimension_type", F.lit("tool"))
    out = _fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), [runs, models, tools])
    return out.where("day is not null").select("day", "instance_id", "dimension_type", "dimension_value", "requests", "errors", "tokens", "costUsd")


@dataclass(frozen=True)
class Retention:
    """Days to keep; ``None`` keeps everything."""

    # fixed values: default days
    events: int | None = 7
    samples: int | None = 30
    projections: int | None = None


PROJECTION_TIMES = {"llm_calls": "started_at", "tool_calls": "started_at", "mcp_calls": "started_at", "subagent_runs": "started_at", "agent_runs": "started_at",
                    "sessions": "coalesce(started_at, ended_at)", "retry_events": "occurred_at"}


def rules(config: Retention) -> dict[str, tuple[str, int | None]]:
    """Table -> (time expression, days)."""
    return {"events": ("occurred_at", config.events), "resource_samples": ("sampled_at", config.samples),
            **{name: (time, config.projections) for name, time in PROJECTION_TIMES.items()}}


def expired(time: str, days: int, now: str) -> Column:
    """Rows without a time never expire."""
    return F.expr(time) < instant(now) - F.expr(f"interval {days} days")


def retention_plan(t: Tables, now: str, config: Retention = Retention()) -> DataFrame:
    """(table, total, expired, untimed) for every table with a limit."""
    parts = []
    for name, (time, days) in rules(config).items():
        if days is None:
            continue
        df = t.ledger if name == "events" else t.get(name)
        parts.append(df.agg(F.count("*").alias("total"), F.count_if(expired(time, days, now)).alias("expired"), F.count_if(F.expr(time).isNull()).alias("untimed"))
                     .select(F.lit(name).alias("name"), "total", "expired", "untimed"))
    return _fold(DataFrame.unionByName, parts)


def kept(df: DataFrame, time: str, days: int | None, now: str) -> DataFrame:
    return df if days is None else df.where(~F.coalesce(expired(time, days, now), F.lit(False)))


def backpressure_transitions(ledger: DataFrame) -> DataFrame:
    """Heartbeats at which an instance's queue passes 80 percent of its capacity, either way."""
    beats = ledger.where("event_type = 'gateway.heartbeat'").select(
        "event_id", "instance_id", "producer_id", "sequence", "received_at", "occurred_at", payload_number("queueDepth").alias("depth"), payload_number("queueCapacity").alias("capacity"))
    beats = beats.where("capacity > 0").withColumn("saturated", F.col("depth") >= F.col("capacity") * SATURATED)
    rows = previous(beats, ["instance_id"], ["received_at", "producer_id", "sequence", "event_id"], time_slice("received_at"), {"_was": "saturated"})
    return (rows.where(F.col("saturated") != F.coalesce("_was", F.lit(False)))
            .select("event_id", "instance_id", "occurred_at", F.when(F.col("saturated"), "saturated").otherwise("recovered").alias("edge"), "depth", "capacity"))
