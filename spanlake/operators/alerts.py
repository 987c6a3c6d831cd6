"""Alert rules over the statistics, and what users did with the alerts."""

from __future__ import annotations

from functools import reduce as _fold

from pyspark.sql import Column, DataFrame, functions as F

from ..tables import Tables
from .filters import Filters, blank_to, instant, narrowed
from .stats import SYSTEM_EVENTS, agent_stats, model_stats, tool_stats
from .summary import Thresholds, last_five
from .timeseries import cost_summary, timeseries_points

LEAST_SAMPLES = 3


def _alert(df: DataFrame, ident: Column, severity: Column, source: Column, target: Column, value: Column, at: Column | None = None) -> DataFrame:
    return df.select(ident.alias("id"), severity.alias("severity"), source.alias("source"), target.cast("string").alias("target"), value.cast("double").alias("value"),
                     (at if at is not None else F.lit(None)).cast("timestamp").alias("occurredAt"))


def _above(df: DataFrame, value: Column, warning: float, critical: float) -> tuple[DataFrame, Column]:
    return df.where(value >= warning), F.when(value >= critical, "critical").otherwise("warning")


def minutes_since(at: str, now: Column) -> Column:
    return (F.unix_millis(now) - F.unix_millis(at)) / F.lit(60000.0)


def staleness(t: Tables, now: str) -> DataFrame:
    """(subject, id, ageMinutes, severity) of the event stream and of every instance that is not down."""
    clock = instant(now)
    stream = t.ledger.agg(F.max("received_at").alias("at")).where("at is not null").select(
        F.lit("stream").alias("subject"), F.lit("event-stream").alias("id"), minutes_since("at", clock).alias("ageMinutes"), "at", F.lit(10.0).alias("_w"), F.lit(30.0).alias("_c"))
    hosts = t.instances.where("status = 'up' and last_seen_at is not null").select(
        F.lit("instance").alias("subject"), F.col("instance_id").alias("id"), minutes_since("last_seen_at", clock).alias("ageMinutes"), F.col("last_seen_at").alias("at"),
        F.lit(5.0).alias("_w"), F.lit(15.0).alias("_c"))
    age = F.col("ageMinutes")
    return stream.unionByName(hosts).select("subject", "id", "ageMinutes", F.col("at").alias("lastAt"),
                                            F.when(age >= F.col("_c"), "critical").when(age >= F.col("_w"), "warning").otherwise("").alias("severity"))


def evaluate_alerts(t: Tables, now: str, p: Filters = Filters(), limits: Thresholds = Thresholds(), bucket: str = "1h") -> DataFrame:
    """All alerts, critical ones first.  Each rule is one select over statistics that are already small."""
    lit = F.lit
    clock = instant(now)
    enough = lambda c: F.col(c) >= LEAST_SAMPLES
    parts = []
    agents = agent_stats(t, p).where(enough("runs"))
    df, severity = _above(agents, F.col("errorRate"), limits.error_rate_warning, limits.error_rate_critical)
    parts.append(_alert(df, F.concat(lit("agent-error:"), "agentId"), severity, lit("agent"), F.col("agentId"), F.col("errorRate")))
    models = model_stats(t, p).where(enough("requests"))
    ident = F.concat(F.col("provider"), lit(":"), F.col("model"))
    df, severity = _above(models, F.col("errorRate"), limits.error_rate_warning, limits.error_rate_critical)
    parts.append(_alert(df, F.concat(lit("model-error:"), ident), severity, lit("model"), F.col("model"), F.col("errorRate")))
    df, severity = _above(models, F.col("averageDurationMs"), limits.llm_latency_warning_ms, limits.llm_latency_critical_ms)
    parts.append(_alert(df, F.concat(lit("model-latency:"), ident), severity, lit("model"), F.col("model"), F.col("averageDurationMs")))
    tools = tool_stats(t, p).where(enough("calls"))
    ident = F.concat(F.col("source"), lit(":"), F.col("tool"))
    df, severity = _above(tools, F.col("failureRate"), limits.error_rate_warning, limits.error_rate_critical)
    parts.append(_alert(df, F.concat(lit("tool-error:"), ident), severity, F.col("source"), F.col("tool"), F.col("failureRate")))
    df, severity = _above(tools, F.col("p99DurationMs"), limits.tool_p99_warning_ms, limits.tool_p99_critical_ms)
    parts.append(_alert(df, F.concat(lit("tool-latency:"), ident), severity, F.col("source"), F.col("tool"), F.col("p99DurationMs")))
    open_ = narrowed(t.sessions, p).where("status = 'active' and started_at is not null").withColumn("_age", (F.unix_millis(clock) - F.unix_millis("started_at")).cast("double"))
    df, severity = _above(open_, F.col("_age"), limits.session_stuck_ms, 2 * limits.session_stuck_ms)
    parts.append(_alert(df, F.concat(lit("session-stuck:"), "instance_id", lit(":"), "session_id"), severity, lit("session"), F.col("session_id"), F.col("_age"), F.col("started_at")))
    system = narrowed(t.ledger.where(F.col("event_type").isin(SYSTEM_EVENTS)), p, "occurred_at", None)
    parts.append(_alert(system, F.concat(lit("system:"), "event_id"), lit("critical"), lit("system"), F.col("event_id"), lit(None), F.col("occurred_at")))
    budget = limits.cost_budget_usd
    if budget > 0:
        df, severity = _above(cost_summary(t, p, now), F.col("lastMonthCost"), 0.8 * budget, budget)
        parts.append(_alert(df, lit("cost-budget:monthly"), severity, lit("cost"), lit("monthly"), F.col("lastMonthCost")))
    old = staleness(t, now).where("severity <> ''")
    stream = F.col("subject") == "stream"
    parts.append(_alert(old, F.when(stream, "stream:event-stale").otherwise(F.concat(lit("instance:stale:"), "id")), F.col("severity"), lit("system"), F.col("id"),
                        F.col("ageMinutes"), F.when(stream, F.col("lastAt"))))
    stall = last_five(timeseries_points(t, p, bucket)).where("n >= 5 and sampled and not any")
    parts.append(_alert(stall, lit("stream:data-flow-stall"), lit("critical"), lit("system"), lit("event-stream"), lit(None)))
    down = t.instances.where("status in ('stopped', 'crashed')")
    parts.append(_alert(down, F.concat(lit("instance:down:"), "instance_id"), lit("critical"), lit("system"), F.col("instance_id"), lit(None)))
    return _fold(DataFrame.unionByName, parts).orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), "id")


def apply_alert_state(alerts: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """Alerts with ``acknowledged`` and ``silenced`` from (id, acknowledged, silenced_until)."""
    df = alerts.join(state, "id", "left")
    return (df.withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))
            .withColumn("silenced", F.coalesce(F.col("silenced_until") > instant(now), F.lit(False))).withColumnRenamed("silenced_until", "silencedUntil"))
