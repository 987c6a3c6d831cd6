"""Per-agent, per-model, per-tool and error statistics.

Ranges test ``started_at``, so rows known only from their end do not appear in a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import written
from ..functions.quantiles import rank_quantiles
from ..tables import Tables
from .attribution import Measure, RUN_KEY, llm_named, of_runs, rolled_up, run_agents, tool_events, with_agent
from .filters import Filters, blank_to, narrowed

SYSTEM_EVENTS = ["gateway.crashed", "monitor.events_dropped", "monitor.plugin_error"]
TAILS = {"p95DurationMs": 0.95, "p99DurationMs": 0.99}

TOKENS = [Measure("inputTokens", "input_tokens"), Measure("outputTokens", "output_tokens"),
          Measure("cacheReadTokens", "cache_read_tokens"), Measure("cacheWriteTokens", "cache_write_tokens")]
TOKEN_NAMES = [m.name for m in TOKENS]
ALL_TOKENS = "input_tokens + output_tokens + cache_read_tokens + cache_write_tokens"
COST = Measure("cost", "cost_usd")
REQUESTS = Measure("requests", "cast(1 as bigint)")


def count_if(condition: str) -> str:
    return f"cast(case when {condition} then 1 else 0 end as bigint)"


def count(condition: str):
    return F.count_if(F.expr(condition))


def dollars(name: str = "cost"):
    return F.col(name).cast("double").alias("costUsd")


def percent(part: str, whole: str):
    return F.expr(f"try_divide(1e2 * {part}, {whole})")


def agent_stats(t: Tables, p: Filters = Filters()) -> DataFrame:
    """Runs, errors, rates, durations, calls, tokens and cost per agent, most tokens first.

    Both kinds of calls are summed per run before they join, on the key the runs are already shuffled by.  Under a filter,
    calls of other runs are left out before the sums.
    """
    runs = run_agents(t, p).select(*RUN_KEY, "agent_id", "status", "duration_ms")
    calls = of_runs(t.llm_calls, t, p).groupBy(*RUN_KEY).agg(
        F.count("*").alias("llmRequests"), count("status = 'failed'").alias("llmErrors"),
        *[m.first() for m in TOKENS], COST.first(), F.sum(F.coalesce("duration_ms", F.lit(0.0))).alias("llmDurationMs"))
    tools = of_runs(tool_events(t), t, p).groupBy(*RUN_KEY).agg(
        F.count("*").alias("toolCalls"), count("status = 'failed'").alias("toolErrors"),
        F.sum(F.coalesce("duration_ms", F.lit(0.0))).alias("toolDurationMs"))
    totals = ["llmRequests", "llmErrors", *TOKEN_NAMES, "llmDurationMs", "toolCalls", "toolErrors", "toolDurationMs"]
    out = (runs.join(calls, RUN_KEY, "left").join(tools, RUN_KEY, "left")
           .groupBy("agent_id").agg(
               F.count("*").alias("runs"),
               *[count(cond).alias(name) for name, cond in (
                   ("runErrors", "status = 'failed'"), ("completedRuns", "status = 'completed'"), ("activeRuns", "status = 'active'"))],
               F.sum(F.coalesce("duration_ms", F.lit(0.0))).alias("totalDurationMs"), F.avg("duration_ms").alias("averageDurationMs"),
               *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals], F.coalesce(F.sum("cost"), F.lit(0)).alias("cost")))
    return (out.select(F.col("agent_id").alias("agentId"), "runs", "runErrors", "completedRuns", "activeRuns",
                       percent("runErrors", "runs").alias("errorRate"), percent("completedRuns", "runs").alias("successRate"),
                       "totalDurationMs", "averageDurationMs", *totals,
                       F.expr(" + ".join(TOKEN_NAMES)).alias("totalTokens"), dollars())
            .orderBy(F.desc("totalTokens"), F.desc("runs"), "agentId"))


def agent_model_stats(t: Tables, p: Filters = Filters()) -> DataFrame:
    per_run = (of_runs(llm_named(t.llm_calls), t, p).groupBy(*RUN_KEY, "provider", "model")
               .agg(REQUESTS.first(), *[m.first() for m in TOKENS], COST.first()))
    runs = run_agents(t, p).select(*RUN_KEY, F.col("agent_id").alias("agentId"))
    out = (per_run.join(runs, RUN_KEY).groupBy("agentId", "provider", "model")
           .agg(REQUESTS.again(), *[m.again() for m in TOKENS], COST.again()))
    return (out.select("agentId", "provider", "model", "requests", *TOKEN_NAMES,
                       F.expr(" + ".join(TOKEN_NAMES)).alias("totalTokens"), dollars())
            .orderBy(F.desc("totalTokens"), "agentId", "provider", "model"))


def lifetime_stats(t: Tables) -> DataFrame:
    out = t.llm_calls.agg(F.count("*").alias("totalRequests"),
                          *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (
                              ("totalInputTokens", "input_tokens"), ("totalOutputTokens", "output_tokens"),
                              ("totalCacheReadTokens", "cache_read_tokens"), ("totalCacheWriteTokens", "cache_write_tokens"))],
                          F.coalesce(F.sum(F.expr(ALL_TOKENS)), F.lit(0)).alias("totalTokens"),
                          F.coalesce(F.sum("cost_usd").cast("double"), F.lit(0.0)).alias("totalCostUsd"))
    return out


TOOL_MEASURES = [
    Measure("calls", "cast(1 as bigint)"), Measure("errors", count_if("status = 'failed'")),
    Measure("active", count_if("status = 'active'")), Measure("done", count_if("status = 'completed'")),
    Measure("duration", "duration_ms"), Measure("timed", count_if("duration_ms is not null")),
    Measure("maxDurationMs", "duration_ms", "max"),
    Measure("timeouts", count_if("contains(lower(coalesce(error_category, '')), 'timeout')")),
    Measure("retries", count_if("coalesce(attempt, 1) > 1 or coalesce(retry_reason, '') <> ''")),
]


def tool_rollup(events: DataFrame, t: Tables, p: Filters, dims: list[str], by_agent: bool) -> DataFrame:
    """Counts, rates and rank percentiles per ``dims``; the hot path never sorts the calls of a tool."""
    keys = dims + (["agent_id"] if by_agent else [])
    each = written(rolled_up(events, t, p, dims + ["duration_ms"], TOOL_MEASURES, by_agent))  # the calls are read once
    sums = each.groupBy(*keys).agg(*[m.again() for m in TOOL_MEASURES])
    tails = rank_quantiles(each, keys, "duration_ms", TAILS, weight="calls")
    return sums.join(tails, keys, "left").select(
        *keys, "calls", "errors", "active", percent("errors", "calls").alias("failureRate"), percent("done", "calls").alias("successRate"),
        F.expr("try_divide(duration, timed)").alias("averageDurationMs"), "maxDurationMs", *TAILS, "timeouts", "retries")


PAGE = 200  # rows a reader is shown; operators that read a statistic take all of it


def page(df: DataFrame, order: list, top: int | None) -> DataFrame:
    """All rows in order, or the first ``top`` of them."""
    return df.orderBy(*order) if top is None else df.orderBy(*order).limit(top)


def tool_stats(t: Tables, p: Filters = Filters(), top: int | None = None) -> DataFrame:
    events = narrowed(tool_events(t), p)
    return page(tool_rollup(events, t, p, ["source", "tool"], False), [F.desc("calls"), "source", "tool"], top)


MODEL_MEASURES = [
    REQUESTS, Measure("errors", count_if("status = 'failed'")), Measure("active", count_if("status = 'active'")),
    Measure("done", count_if("status = 'completed'")), *TOKENS, COST,
    Measure("duration", "duration_ms"), Measure("timed", count_if("duration_ms is not null")), Measure("maxDurationMs", "duration_ms", "max"),
    Measure("ttfb", "time_to_first_byte_ms"), Measure("ttfbs", count_if("time_to_first_byte_ms is not null")),
    Measure("ttft", "time_to_first_token_ms"), Measure("ttfts", count_if("time_to_first_token_ms is not null")),
    Measure("generation", "generation_duration_ms"),
]


def model_stats(t: Tables, p: Filters = Filters(), top: int | None = None) -> DataFrame:
    calls = narrowed(llm_named(t.llm_calls), p)
    sums = rolled_up(calls, t, p, ["provider", "model"], MODEL_MEASURES)
    ranked = page(sums.withColumn("_tokens", F.expr(" + ".join(TOKEN_NAMES))), [F.desc("_tokens"), F.desc("requests"), "provider", "model"], top)
    return (ranked
            .select("provider", "model", "requests", "errors", "active", percent("errors", "requests").alias("errorRate"),
                    percent("done", "requests").alias("successRate"), *TOKEN_NAMES, dollars(),
                    F.expr("try_divide(duration, timed)").alias("averageDurationMs"), "maxDurationMs",
                    F.expr("try_divide(ttfb, ttfbs)").alias("averageTimeToFirstByteMs"),
                    F.expr("try_divide(ttft, ttfts)").alias("averageTimeToFirstTokenMs"),
                    F.expr("case when generation > 0 then 1e3 * outputTokens / generation end").alias("generationTokensPerSecond"),
                    F.expr("case when duration > 0 then 1e3 * outputTokens / duration else 0e0 end").alias("outputTokensPerSecond")))


def _failures(t: Tables) -> list[tuple[str, DataFrame, str, str]]:
    return [("llm", t.llm_calls, "call_id", "model"), ("tool", t.tool_calls, "tool_call_id", "tool_name"),
            ("mcp", t.mcp_calls, "call_id", "tool_name")]


def error_stats(t: Tables, p: Filters = Filters(), top: int | None = None) -> DataFrame:
    """Failures by kind and category; nothing when a status other than failed is asked for."""
    wanted = p.but(status=None)
    measures = [Measure("errors", "cast(1 as bigint)"), Measure("duration", "duration_ms"),
                Measure("timed", count_if("duration_ms is not null")), Measure("lastOccurredAt", "started_at", "max")]
    names = ["category", "errors", "duration", "timed", "lastOccurredAt"]
    runs = run_agents(t, wanted.but(status="failed")).withColumn("category", blank_to("error_category"))
    parts = [runs.groupBy("category").agg(*[m.first() for m in measures]).withColumn("kind", F.lit("run"))]
    for kind, calls, _, _ in _failures(t):
        failed = narrowed(calls.where("status = 'failed'"), wanted).withColumn("category", blank_to("error_category"))
        parts.append(rolled_up(failed, t, wanted, ["category"], measures).withColumn("kind", F.lit(kind)))
    if not p.agent or p.agent == "unknown":
        system = narrowed(t.ledger.where(F.col("event_type").isin(SYSTEM_EVENTS)), wanted, "occurred_at")
        parts.append(system.groupBy(F.col("event_type").alias("category")).agg(
            F.count("*").alias("errors"), F.lit(None).cast("double").alias("duration"), F.lit(0).cast("bigint").alias("timed"),
            F.max("occurred_at").alias("lastOccurredAt")).withColumn("kind", F.lit("system")))
    out = parts[0].select("kind", *names)
    for part in parts[1:]:
        out = out.unionByName(part.select("kind", *names))
    if p.status not in (None, "", "failed"):
        out = out.where(F.lit(False))
    shown = out.select("kind", "category", "errors", F.expr("try_divide(duration, timed)").alias("averageDurationMs"), "lastOccurredAt")
    return page(shown, [F.desc("errors"), F.desc("lastOccurredAt"), "kind", "category"], top)


def recent_anomalies(t: Tables, p: Filters = Filters()) -> DataFrame:
    """The newest failures of every kind.

    Each kind is cut to the newest rows before it meets the runs, unless the agent filter needs the join first.
    """
    from .reduce import payload_text

    wanted = p.but(status=None)
    cols = ["instance_id", "kind", "id", "session_id", "run_id", "label", "category", "occurred_at", "duration_ms", "trace_id", "span_id"]

    def cut(df: DataFrame) -> DataFrame:
        return df.orderBy(F.desc("occurred_at"), F.desc("id"), F.desc("instance_id"), F.desc("kind")).limit(p.rows)

    parts = []
    for kind, calls, key, label in _failures(t):
        df = (calls.where("status = 'failed'")
              .withColumn("occurred_at", F.coalesce("ended_at", "started_at")))
        df = narrowed(df, wanted, "occurred_at").select(
            "instance_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), "session_id", "run_id", blank_to(label).alias("label"),
            blank_to("error_category").alias("category"), "occurred_at", "duration_ms",
            F.nullif("trace_id", F.lit("")).alias("trace_id"), F.coalesce(F.nullif("span_id", F.lit("")), key).alias("span_id"))
        parts.append(df if p.agent else cut(df))
    calls = parts[0].unionByName(parts[1]).unionByName(parts[2])
    calls = with_agent(calls, t, p, ["trace_id"])
    calls = calls.withColumn("trace_id", F.coalesce("trace_id", F.nullif("run_trace_id", F.lit("")), "run_id")).select(*cols, "agent_id")
    runs = run_agents(t, Filters(status="failed", agent=p.agent)).withColumn("occurred_at", F.coalesce("ended_at", "started_at"))
    runs = narrowed(runs, wanted, "occurred_at").select(
        "instance_id", F.lit("run").alias("kind"), F.col("run_id").alias("id"), "session_id", "run_id",
        F.coalesce(F.nullif("model", F.lit("")), "run_id").alias("label"), blank_to("error_category").alias("category"),
        "occurred_at", "duration_ms", F.coalesce(F.nullif("trace_id", F.lit("")), "run_id").alias("trace_id"),
        F.coalesce(F.nullif("span_id", F.lit("")), "run_id").alias("span_id"), "agent_id")
    out = calls.unionByName(runs)
    if not p.agent or p.agent == "unknown":
        none = F.lit(None).cast("string")
        system = narrowed(t.ledger.where(F.col("event_type").isin(SYSTEM_EVENTS)), wanted, "occurred_at").select(
            "instance_id", F.lit("system").alias("kind"), F.col("event_id").alias("id"), none.alias("session_id"), none.alias("run_id"),
            F.col("event_type").alias("label"),
            F.coalesce(F.nullif(payload_text("reason"), F.lit("")), "event_type").alias("category"), "occurred_at",
            F.lit(None).cast("double").alias("duration_ms"), none.alias("trace_id"), none.alias("span_id"), F.lit("unknown").alias("agent_id"))
        out = out.unionByName(cut(system))
    return cut(out).select("kind", "id", F.col("session_id").alias("sessionId"), F.col("run_id").alias("runId"),
                           F.col("agent_id").alias("agentId"), "label", "category", F.col("occurred_at").alias("occurredAt"),
                           F.col("duration_ms").alias("durationMs"), F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"))
