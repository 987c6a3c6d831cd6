"""Bucketed series, cost trends and processor use."""

from __future__ import annotations

from functools import reduce as _fold

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import previous, time_slice
from ..tables import Tables
from .attribution import Measure, llm_named, rolled_up, run_agents, tool_events
from .filters import Filters, PERIODS, bucket_seconds, instant, narrowed
from .stats import COST, REQUESTS, TOKENS, TOKEN_NAMES, count, count_if, dollars, tool_rollup

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def bucket_of(time: str, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(F.col(time)) / F.lit(float(seconds))) * seconds)


def cpu_percent(t: Tables, p: Filters = Filters()) -> DataFrame:
    """Processor use between consecutive samples of one process; none when less than a second apart."""
    samples = narrowed(t.resource_samples, p, "sampled_at", None)
    samples = previous(samples, ["instance_id", "process_id"], ["sampled_at", "event_id"], time_slice("sampled_at"),
                       {"before_cpu": "cpu_seconds_total", "before_at": "sampled_at"})
    gap = F.unix_seconds("sampled_at") - F.unix_seconds("before_at")
    return samples.withColumn("cpu_percent", F.when(gap > 0, F.lit(100.0) * (F.col("cpu_seconds_total") - F.col("before_cpu")) / gap))


POINT_SUMS = ["runs", "runErrors", "runDurationMs", "llmRequests", "llmErrors", *TOKEN_NAMES, "cost", "llmDuration", "llmTimed",
              "toolCalls", "toolErrors"]
POINT_TOPS = ["averageMemoryBytes", "maxMemoryBytes", "averageCpuPercent", "diskTotalBytes", "diskAvailableBytes"]


def timeseries_points(t: Tables, p: Filters = Filters(), bucket: str = "1h") -> DataFrame:
    """One row per bucket with activity or samples; each source is summed per bucket before the union.

    Processor shares are summed as decimals, so the mean does not depend on how rows are split over tasks.
    """
    s = bucket_seconds(bucket, p)
    at = bucket_of("started_at", s)
    runs = (run_agents(t, p).groupBy(at.alias("time"))
            .agg(F.count("*").alias("runs"), count("status = 'failed'").alias("runErrors"),
                 F.sum(F.coalesce("duration_ms", F.lit(0.0))).alias("runDurationMs")))
    llm = rolled_up(narrowed(t.llm_calls, p).withColumn("time", at), t, p, ["time"],
                    [Measure("llmRequests", "cast(1 as bigint)"), Measure("llmErrors", count_if("status = 'failed'")), *TOKENS, COST,
                     Measure("llmDuration", "coalesce(duration_ms, 0e0)"), Measure("llmTimed", count_if("duration_ms is not null"))])
    tools = rolled_up(narrowed(tool_events(t), p).withColumn("time", at), t, p, ["time"],
                      [Measure("toolCalls", "cast(1 as bigint)"), Measure("toolErrors", count_if("status = 'failed'"))])
    host = (cpu_percent(t, p).groupBy(bucket_of("sampled_at", s).alias("time"))
            .agg(F.avg("resident_memory_bytes").alias("averageMemoryBytes"), F.max("resident_memory_bytes").alias("maxMemoryBytes"),
                 F.expr("try_divide(cast(sum(cast(cpu_percent as decimal(28,6))) as double), count(cpu_percent))").alias("averageCpuPercent"), F.avg("disk_total_bytes").alias("diskTotalBytes"),
                 F.avg("disk_available_bytes").alias("diskAvailableBytes")))
    parts = _fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), [runs, llm, tools, host])
    out = parts.where("time is not null").groupBy("time").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in POINT_SUMS], *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in POINT_TOPS])
    return out.select(
        "time", "runs", "runErrors", "runDurationMs", "llmRequests", "llmErrors",
        F.expr("case when llmRequests > 0 then 1e2 * llmErrors / llmRequests else 0e0 end").alias("llmErrorRate"),
        *TOKEN_NAMES, dollars(), F.expr("case when llmTimed > 0 then llmDuration / llmTimed else 0e0 end").alias("averageLlmDurationMs"),
        "toolCalls", "toolErrors", *POINT_TOPS,
        F.expr("case when diskTotalBytes > 0 then 1e2 * (diskTotalBytes - diskAvailableBytes) / diskTotalBytes else 0e0 end").alias("diskUsedPercent"),
    ).orderBy("time")


def timeseries_models(t: Tables, p: Filters = Filters(), bucket: str = "1h") -> DataFrame:
    calls = narrowed(llm_named(t.llm_calls), p).withColumn("time", bucket_of("started_at", bucket_seconds(bucket, p)))
    out = rolled_up(calls, t, p, ["time", "provider", "model"], [REQUESTS, *TOKENS, COST])
    return (out.select("time", "provider", "model", "requests", *TOKEN_NAMES, dollars())
            .orderBy("time", F.desc("requests"), "provider", "model"))


def timeseries_agents(t: Tables, p: Filters = Filters(), bucket: str = "1h") -> DataFrame:
    at = bucket_of("started_at", bucket_seconds(bucket, p))
    return (run_agents(t, p).groupBy(at.alias("time"), F.col("agent_id").alias("agentId"))
            .agg(F.count("*").alias("runs"), count("status = 'failed'").alias("errors"),
                 F.sum(F.coalesce("duration_ms", F.lit(0.0))).alias("durationMs"))
            .orderBy("time", F.desc("runs"), "agentId"))


def timeseries_tools(t: Tables, p: Filters = Filters(), bucket: str = "1h") -> DataFrame:
    """Rows without a start time have no bucket and are left out here."""
    s = bucket_seconds(bucket, p)
    events = narrowed(tool_events(t), p).where("started_at is not null").withColumn("time", bucket_of("started_at", s))
    return (tool_rollup(events, t, p, ["time", "source", "tool"], True).withColumnRenamed("agent_id", "agentId").drop("retries")
            .orderBy("time", F.desc("calls"), "source", "tool", "agentId"))


def timeseries(t: Tables, p: Filters = Filters(), bucket: str = "1h") -> dict[str, DataFrame]:
    return {"points": timeseries_points(t, p, bucket), "models": timeseries_models(t, p, bucket),
            "agents": timeseries_agents(t, p, bucket), "tools": timeseries_tools(t, p, bucket)}


def period_of(time: str, period: str) -> Column:
    """Calendar period eight hours ahead of UTC; weeks start on Monday, days before the first Monday are week 00."""
    local = F.col(time) + F.expr("interval 8 hours")
    if period == "day":
        return F.date_format(local, "yyyy-MM-dd")
    if period == "month":
        return F.date_format(local, "yyyy-MM")
    if period == "week":
        week = F.floor((F.dayofyear(local) + 6 - F.weekday(local)) / F.lit(7.0))
        return F.concat(F.date_format(local, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    raise ValueError(f"period must be one of {PERIODS}")


def cost_trends(t: Tables, p: Filters = Filters(), period: str = "day") -> DataFrame:
    calls = narrowed(llm_named(t.llm_calls), p).withColumn("period", period_of("started_at", period))
    out = rolled_up(calls, t, p, ["period", "provider", "model"], [REQUESTS, *TOKENS, COST], by_agent=True)
    return (out.select("period", "provider", "model", F.col("agent_id").alias("agentId"), "requests", *TOKEN_NAMES, dollars())
            .orderBy(F.desc("period"), F.desc("costUsd"), "provider", "model", "agentId"))


def cost_summary(t: Tables, p: Filters = Filters(), now: str | None = None) -> DataFrame:
    """Totals and the cost of the last 1, 7 and 30 days before ``now``."""
    clock = instant(now) if now else F.current_timestamp()
    measures = [Measure("totalRequests", "cast(1 as bigint)"), Measure("cost", "cost_usd"),
                Measure("totalTokens", "input_tokens + output_tokens + cache_read_tokens + cache_write_tokens"),
                Measure("top", "cost_usd", "max")]
    windows = (("lastDayCost", 1), ("lastWeekCost", 7), ("lastMonthCost", 30))
    for name, days in windows:
        measures.append(Measure(name, F.when(F.col("started_at") >= clock - F.expr(f"interval {days} days"), F.col("cost_usd"))
                                .otherwise(F.lit(0).cast("decimal(18,6)"))))
    calls = narrowed(t.llm_calls, p)
    if p.agent:
        sums = rolled_up(calls, t, p, [], measures)
    else:
        sums = calls.agg(*[m.first() for m in measures])
    out = sums.agg(*[m.again() for m in measures]) if p.agent else sums
    return out.select(F.coalesce("totalRequests", F.lit(0)).alias("totalRequests"), F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("totalCost"),
                      F.coalesce("totalTokens", F.lit(0)).alias("totalTokens"), F.expr("try_divide(cast(cost as double), totalRequests)").alias("avgCostPerRequest"),
                      F.col("top").cast("double").alias("maxCostPerRequest"),
                      *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n, _ in windows])
