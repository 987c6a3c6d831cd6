"""Headline numbers, shares and matrices over the statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce as _fold

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.quantiles import NEAREST, rank_quantiles
from ..tables import Tables
from .filters import Filters, blank_to, instant, narrowed
from .lists import list_llm_calls, session_totals
from .stats import TOKEN_NAMES, agent_model_stats, agent_stats, count, error_stats, lifetime_stats, model_stats, tool_stats
from .timeseries import cost_summary, cost_trends, timeseries_agents, timeseries_models, timeseries_points, timeseries_tools


@dataclass(frozen=True)
class Thresholds:
    # fixed values: default limits
    error_rate_warning: float = 5
    error_rate_critical: float = 15
    llm_latency_warning_ms: float = 5000
    llm_latency_critical_ms: float = 15000
    tool_p99_warning_ms: float = 5000
    tool_p99_critical_ms: float = 15000
    session_stuck_ms: float = 3600000
    cost_budget_usd: float = 0


def exact(name: str) -> Column:
    """A sum of costs that does not depend on the order of rows."""
    return F.coalesce(F.sum(F.col(name).cast("decimal(28,6)")), F.lit(0)).cast("double")


def one_row(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct value."""
    return df.select(F.struct(*df.columns)).scalar()


def long(df: DataFrame, columns: dict[str, Column], levels: dict[str, Column] | None = None) -> DataFrame:
    """One row (id, value, level) per named column of a one-row frame."""
    levels = levels or {}
    items = [F.struct(F.lit(k).alias("id"), v.cast("double").alias("value"), levels.get(k, F.lit("")).alias("level")) for k, v in columns.items()]
    return df.select(F.inline(F.array(*items)))


def level(value: Column, warning: float, critical: float) -> Column:
    return F.when(value >= critical, "critical").when(value >= warning, "warning").otherwise("")


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


AGENT_SUMS = ["runs", "runErrors", "completedRuns", "llmRequests", "llmErrors", *TOKEN_NAMES, "totalTokens", "toolCalls", "toolErrors"]


def _agent_totals(t: Tables, p: Filters) -> DataFrame:
    agents = agent_stats(t, p)
    return agents.agg(F.count("*").alias("agents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in AGENT_SUMS],
                      *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("llmDurationMs", "toolDurationMs")], exact("costUsd").alias("costUsd"))


def _last_points(points: DataFrame) -> DataFrame:
    def last(value: str, positive: str) -> Column:
        return F.coalesce(F.max_by(value, F.when(F.col(positive) > 0, F.col("time"))), F.lit(0.0)).alias(value)
    return points.agg(last("diskUsedPercent", "diskTotalBytes"), last("maxMemoryBytes", "maxMemoryBytes"), last("averageCpuPercent", "averageCpuPercent"))


def kpis(t: Tables, p: Filters = Filters(), bucket: str = "1h", limits: Thresholds = Thresholds()) -> DataFrame:
    """(id, value, level) of the 22 front-page numbers."""
    a = {c: F.col(c) for c in ("agents", *AGENT_SUMS, "llmDurationMs", "toolDurationMs", "costUsd")}
    error_rate = ratio(F.lit(100.0) * a["runErrors"], a["runs"])
    llm_rate = ratio(F.lit(100.0) * a["llmErrors"], a["llmRequests"])
    latency = ratio(a["llmDurationMs"], a["llmRequests"])
    errors = level(error_rate, limits.error_rate_warning, limits.error_rate_critical)
    totals = long(_agent_totals(t, p), {
        "runs": a["runs"], "llmRequests": a["llmRequests"], "totalTokens": a["totalTokens"], "toolCalls": a["toolCalls"], "avgLlmLatency": latency, "cost": a["costUsd"],
        **{n: a[n] for n in TOKEN_NAMES}, "llmErrors": a["llmErrors"], "runErrors": a["runErrors"], "toolErrors": a["toolErrors"], "errorRate": error_rate,
        "toolDuration": a["toolDurationMs"], "agentCount": a["agents"],
    }, {"runs": errors, "runErrors": errors, "errorRate": errors, "avgLlmLatency": level(latency, limits.llm_latency_warning_ms, limits.llm_latency_critical_ms),
        "llmErrors": level(llm_rate, limits.error_rate_warning, limits.error_rate_critical)})
    host = long(_last_points(timeseries_points(t, p, bucket)), {
        "diskUsage": F.col("diskUsedPercent"), "maxMemory": F.col("maxMemoryBytes"), "avgCpu": F.col("averageCpuPercent")})
    life = long(lifetime_stats(t), {"lifetimeTokens": F.col("totalTokens"), "lifetimeCost": F.col("totalCostUsd")})
    sessions = long(t.sessions.agg(count("status = 'active'").alias("n")), {"activeSessions": F.col("n")})
    return _fold(DataFrame.unionByName, [totals, host, life, sessions])


def last_five(points: DataFrame) -> DataFrame:
    """Whether the five newest points show samples and activity."""
    recent = points.orderBy(F.desc("time")).limit(5)
    busy = "runs > 0 or llmRequests > 0"
    return recent.agg(F.count("*").alias("n"), F.coalesce(F.max(F.expr("averageCpuPercent > 0")), F.lit(False)).alias("sampled"),
                      F.coalesce(F.max(F.expr(busy)), F.lit(False)).alias("busy"),
                      F.coalesce(F.max(F.expr(f"{busy} or toolCalls > 0")), F.lit(False)).alias("any"))


def overview_summary(t: Tables, now: str, p: Filters = Filters(), bucket: str = "1h") -> DataFrame:
    """(id, value, level) of the 18 overview numbers; health and data flow are 1 or 0."""
    a = {c: F.col(c) for c in (*AGENT_SUMS, "llmDurationMs", "costUsd")}
    errors = a["runErrors"] + a["llmErrors"] + a["toolErrors"]
    totals = long(_agent_totals(t, p), {
        "runs": a["runs"], "successRate": ratio(F.lit(100.0) * a["completedRuns"], a["runs"], 100.0), "totalTokens": a["totalTokens"], "cost": a["costUsd"], "errors": errors,
        "llmRequests": a["llmRequests"], "avgLatency": ratio(a["llmDurationMs"], a["llmRequests"]), "toolCalls": a["toolCalls"],
        "cacheRate": ratio(F.lit(100.0) * a["cacheReadTokens"], a["totalTokens"]), "inputTokens": a["inputTokens"], "outputTokens": a["outputTokens"],
        "errorRate": ratio(F.lit(100.0) * a["runErrors"], a["runs"])}, {"errors": F.when(errors > 0, "critical").otherwise("")})
    points = timeseries_points(t, p, bucket)
    host = long(_last_points(points), {"diskUsage": F.col("diskUsedPercent"), "memoryUsage": F.col("maxMemoryBytes")})
    flow_ok = F.col("busy") | ~F.col("sampled")
    flow = long(last_five(points), {"dataFlow": flow_ok.cast("int")}, {"dataFlow": F.when(flow_ok, "").otherwise("critical")})
    active = narrowed(t.sessions, p).where("status = 'active'")
    sessions = long(active.agg(F.count("*").alias("n"), F.count_distinct(F.nullif("agent_id", F.lit(""))).alias("agents")),
                    {"onlineAgents": F.col("agents"), "activeSessions": F.col("n")})
    age = (F.unix_millis(instant(now)) - F.unix_millis("at")) / F.lit(60000.0)
    healthy = F.coalesce(F.round(age) < 10, F.lit(True))
    health = long(t.ledger.agg(F.max("received_at").alias("at")), {"daemonHealth": healthy.cast("int")}, {"daemonHealth": F.when(healthy, "").otherwise("critical")})
    return _fold(DataFrame.unionByName, [totals, host, flow, sessions, health])


def agent_overview(t: Tables, p: Filters = Filters()) -> DataFrame:
    """Agents with their state, sessions and cost per completed run."""
    sessions = (narrowed(t.sessions, p).groupBy(F.col("agent_id").alias("agentId"))
                .agg(count("status = 'active'").alias("activeSessions"), F.count("*").alias("sessions")))
    df = agent_stats(t, p).join(sessions, "agentId", "left").fillna(0, ["activeSessions", "sessions"])
    state = F.when(F.col("activeSessions") > 0, "active").when(F.col("runErrors") > 0, "degraded").otherwise("idle")
    return df.select("agentId", state.alias("state"), "activeSessions", "sessions", "runs", "successRate", "totalTokens", "costUsd",
                     (F.col("costUsd") / F.greatest(F.lit(1), F.col("completedRuns"))).alias("costPerCompletedRun"), "averageDurationMs")


def session_duration(now: str) -> Column:
    """Milliseconds from start to end, an open session up to now; zero without a start."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_millis(F.coalesce("ended_at", instant(now))) - F.unix_millis("started_at")).cast("double")), F.lit(0.0))


def session_summary(t: Tables, now: str, p: Filters = Filters()) -> DataFrame:
    rows = narrowed(t.sessions, p).select("status", "message_count", session_duration(now).alias("took"))
    totals = rows.agg(F.count("*").alias("total"), count("status = 'active'").alias("active"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"))
    marks = rank_quantiles(rows.withColumn("_g", F.lit(0)), ["_g"], "took", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, NEAREST)
    q = one_row(marks.select("p50", "p90", "p99"))
    return totals.select("*", q.alias("_q")).select("total", "active", "messages", *[F.coalesce(F.col("_q." + c), F.lit(0.0)).alias(c) for c in ("p50", "p90", "p99")])


def _weighted(rate: str, weight: str) -> Column:
    return F.coalesce(F.sum((F.coalesce(F.col(rate), F.lit(0.0)) * F.col(weight)).cast("decimal(38,6)")), F.lit(0)).cast("double")


def model_summary(t: Tables, p: Filters = Filters()) -> DataFrame:
    """Totals over the models with request-weighted latency and success."""
    m = model_stats(t, p).agg(
        F.count("*").alias("models"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "errors", *TOKEN_NAMES)], exact("costUsd").alias("cost"),
        _weighted("averageDurationMs", "requests").alias("_took"), _weighted("successRate", "requests").alias("_good"))
    return m.select("models", "requests", "errors", F.expr(" + ".join(TOKEN_NAMES)).alias("totalTokens"), "outputTokens",
                    F.expr("cacheReadTokens + cacheWriteTokens").alias("cacheTokens"), "cost", ratio(F.col("_took"), F.col("requests")).alias("averageDurationMs"),
                    ratio(F.col("_good"), F.col("requests"), 100.0).alias("successRate"))


def tool_summary(t: Tables, p: Filters = Filters()) -> DataFrame:
    """Totals over the tools; the tails are nearest-rank percentiles of the tools' own percentiles."""
    tools = tool_stats(t, p)
    sums = tools.agg(F.count("*").alias("tools"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "errors", "timeouts", "retries")],
                     _weighted("averageDurationMs", "calls").alias("_took"), _weighted("successRate", "calls").alias("_good"),
                     *[F.expr(f"percentile_disc({q}) within group (order by coalesce({c}, 0e0))").alias(c)
                       for c, q in (("p95DurationMs", 0.95), ("p99DurationMs", 0.99))])
    return sums.select("tools", "calls", "errors", ratio(F.col("_good"), F.col("calls"), 100.0).alias("successRate"), ratio(F.col("_took"), F.col("calls")).alias("averageDurationMs"),
                       F.coalesce("p95DurationMs", F.lit(0.0)).alias("p95DurationMs"), F.coalesce("p99DurationMs", F.lit(0.0)).alias("p99DurationMs"), "timeouts", "retries")


def infra_summary(t: Tables, p: Filters = Filters(), bucket: str = "1h") -> DataFrame:
    """The newest point with memory or disk samples."""
    points = timeseries_points(t, p, bucket).where("diskTotalBytes > 0 or averageMemoryBytes > 0")
    last = points.agg(F.max_by(F.struct("time", "averageCpuPercent", "averageMemoryBytes", "diskUsedPercent"), "time").alias("s"))
    return last.select(F.col("s.time").alias("time"), F.coalesce("s.averageCpuPercent", F.lit(0.0)).alias("cpuPercent"),
                       (F.coalesce("s.averageMemoryBytes", F.lit(0.0)) / F.lit(1048576.0)).alias("memoryMiB"), F.coalesce("s.diskUsedPercent", F.lit(0.0)).alias("diskUsedPercent"))


def error_summary(t: Tables, alerts: DataFrame, p: Filters = Filters()) -> DataFrame:
    """Errors by kind, the number of categories, open and critical alerts."""
    errors = error_stats(t, p)

    def of(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("errors"))), F.lit(0))

    sums = errors.agg(of("run").alias("agentErrors"), of("llm").alias("llmErrors"), of("tool", "mcp").alias("toolErrors"), of("system").alias("systemErrors"), F.count("*").alias("categories"))
    open_ = one_row(alerts.agg(F.count_if(~F.col("acknowledged") & ~F.col("silenced")).alias("open"), F.count_if(F.col("severity") == "critical").alias("critical")))
    return sums.select("*", open_.alias("_a")).select("agentErrors", "llmErrors", "toolErrors", "systemErrors", "categories", F.col("_a.open").alias("openAlerts"), F.col("_a.critical").alias("criticalAlerts"))


def month_back(now: str, p: Filters, days: int = 30) -> Filters:
    from datetime import datetime, timedelta
    at = datetime.fromisoformat(now)
    return p.but(start=str(at - timedelta(days=days)), end=str(at))


def cost_forecast(t: Tables, now: str, budget: float = 0, p: Filters = Filters()) -> DataFrame:
    """Cost of the last 30 days, its mean per day with calls, and that mean over the current month."""
    days = cost_trends(t, month_back(now, p), "day").groupBy("period").agg(F.sum(F.col("costUsd").cast("decimal(28,6)")).alias("c"))
    sums = days.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("double").alias("rollingCost"), F.count("*").alias("days"))
    mean = F.col("rollingCost") / F.greatest(F.lit(1), F.col("days"))
    forecast = mean * F.dayofmonth(F.last_day(instant(now)))
    used = F.lit(100.0) * forecast / F.lit(float(budget)) if budget else F.lit(0.0)
    return sums.select("rollingCost", "days", mean.alias("averageDaily"), forecast.alias("forecast"), used.alias("budgetPercent"), level(used, 80, 100).alias("level"))


def cost_top_agents(t: Tables, now: str, p: Filters = Filters(), top: int = 12) -> DataFrame:
    return (cost_trends(t, month_back(now, p), "day").groupBy("agentId").agg(exact("costUsd").alias("costUsd"))
            .orderBy(F.desc("costUsd"), "agentId").limit(top))


def cost_top_sessions(t: Tables, p: Filters = Filters(), top: int = 12) -> DataFrame:
    named = narrowed(t.sessions, p).select(F.col("instance_id").alias("instanceId"), F.col("session_id").alias("sessionId"), blank_to("agent_id").alias("agentId"))
    return (session_totals(t).where("costUsd > 0").join(named, ["instanceId", "sessionId"])
            .orderBy(F.desc("costUsd"), "sessionId", "instanceId").limit(top).select("instanceId", "sessionId", "agentId", "costUsd", "totalTokens"))


def cost_by_model(t: Tables, p: Filters = Filters(), period: str = "day") -> DataFrame:
    """Cost, requests, mean and share of the total per model."""
    rows = cost_trends(t, p, period).groupBy("provider", "model").agg(F.sum(F.col("costUsd").cast("decimal(28,6)")).alias("c"), F.sum("requests").alias("requests"))
    total = rows.agg(F.sum("c").cast("double").alias("v")).scalar()
    cost = F.col("c").cast("double")
    return (rows.select("provider", "model", "requests", cost.alias("costUsd"), (cost / F.col("requests")).alias("averageCost"), total.alias("_t"))
            .select("provider", "model", "requests", "costUsd", "averageCost", ratio(F.lit(100.0) * F.col("costUsd"), F.col("_t")).alias("percentOfTotal"))
            .orderBy(F.desc("costUsd"), "provider", "model"))


def budget_status(t: Tables, now: str, budget: float, p: Filters = Filters()) -> DataFrame:
    spent = F.col("lastMonthCost")
    used = F.least(F.lit(100.0), F.lit(100.0) * spent / F.lit(float(budget))) if budget > 0 else F.lit(0.0)
    return cost_summary(t, p, now).select(spent.alias("lastMonthCost"), F.lit(float(budget)).alias("budget"), used.alias("usedPercent"), level(used, 80, 100).alias("level"),
                                          F.greatest(F.lit(0.0), F.lit(float(budget)) - spent).alias("remaining"))


def activity_heatmap(t: Tables, p: Filters = Filters(), bucket: str = "1h", columns: int = 24) -> DataFrame:
    """Runs per agent and time slot with their share of the busiest cell; more buckets than columns are put into equal slots."""
    rows = timeseries_agents(t, p, bucket).where("time is not null")
    frame = one_row(rows.agg(F.count_distinct("time").alias("n"), F.min("time").alias("lo"), F.max("time").alias("hi")))
    rows = rows.select("time", "agentId", "runs", frame.alias("_f"))
    width = (F.unix_millis("_f.hi") - F.unix_millis("_f.lo")) / F.lit(float(columns))
    slot = F.least(F.lit(columns - 1), F.greatest(F.lit(0), F.floor((F.unix_millis("time") - F.unix_millis("_f.lo")) / F.when(width > 0, width).otherwise(F.lit(1.0 / columns)))))
    cells = (rows.select("agentId", F.when(F.col("_f.n") > columns, F.unix_millis("_f.lo") + ((slot + F.lit(0.5)) * width)).otherwise(F.unix_millis("time")).cast("bigint").alias("_ms"), "runs")
             .groupBy("agentId", "_ms").agg(F.sum("runs").alias("runs")))
    most = cells.agg(F.greatest(F.lit(1), F.max("runs")).alias("m")).scalar()
    return cells.select("agentId", F.timestamp_millis("_ms").alias("slotTime"), "runs", most.alias("_m")).select("agentId", "slotTime", "runs", (F.col("runs") / F.col("_m")).alias("intensity"))


def tool_agent_matrix(t: Tables, p: Filters = Filters(), bucket: str = "1h", agents: int = 12, tools: int = 18) -> DataFrame:
    """Calls per agent and tool for the first agents and tools to appear, with their share of the busiest cell."""
    rows = timeseries_tools(t, p, bucket)
    seen = F.min(F.struct("time", (-F.col("calls")).alias("c"), "source", "tool", "agentId"))
    cells = rows.groupBy("agentId", "tool").agg(F.sum("calls").alias("calls"), seen.alias("_seen"))
    most = cells.agg(F.greatest(F.lit(1), F.max("calls")).alias("m")).scalar()
    first_agents = cells.groupBy("agentId").agg(F.min("_seen").alias("s")).orderBy("s").limit(agents).select("agentId")
    first_tools = cells.groupBy("tool").agg(F.min("_seen").alias("s")).orderBy("s").limit(tools).select("tool")
    kept = cells.join(first_agents, "agentId", "left_semi").join(first_tools, "tool", "left_semi")
    return kept.select("agentId", "tool", "calls", most.alias("_m")).select("agentId", "tool", "calls", (F.col("calls") / F.col("_m")).alias("intensity"))


def tool_share(t: Tables, p: Filters = Filters(), top: int = 7) -> DataFrame:
    """Calls of the top tools, the others together, and each one's calls relative to the greatest tool."""
    tools = tool_stats(t, p).withColumn("_rk", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("calls"), "source", "tool")))
    most = F.first("calls").over(W.partitionBy(F.lit(0)).orderBy("_rk"))
    rows = tools.select("_rk", F.concat("source", F.lit(":"), "tool").alias("name"), "calls", most.alias("_most"))
    label = F.when(F.col("_rk") <= top, F.col("name")).otherwise("Other")
    return rows.groupBy(label.alias("label")).agg(F.sum("calls").alias("calls"), F.max("_most").alias("_most")).select(
        "label", "calls", (F.lit(100.0) * F.col("calls") / F.col("_most")).alias("relativePercent"))


def token_share(t: Tables, p: Filters = Filters()) -> DataFrame:
    return model_stats(t, p).select(F.concat("provider", F.lit("/"), "model").alias("label"), F.expr(" + ".join(TOKEN_NAMES)).alias("totalTokens"))


def latency_scatter(t: Tables, p: Filters = Filters()) -> DataFrame:
    """Tokens against duration of the listed calls."""
    return list_llm_calls(t, p).select("callId", F.concat(blank_to("provider"), F.lit("/"), blank_to("model")).alias("series"),
                                       F.col("totalTokens").cast("double").alias("x"), F.coalesce("durationMs", F.lit(0.0)).alias("y"))


def dense_grid(rows: DataFrame, category: str, series: str, value: str) -> DataFrame:
    """Every category with every series, zero where there is nothing; the series names are at most a few hundred models."""
    cells = rows.groupBy(category, series).agg(F.sum(value).alias(value))
    names = cells.agg(F.array_sort(F.collect_set(series)).alias("v")).scalar()
    frame = cells.select(category).distinct().select(category, names.alias("_n")).select(category, F.explode("_n").alias(series))
    return frame.join(cells, [category, series], "left").select(category, series, F.coalesce(F.col(value), F.lit(0)).alias(value))


def _model_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.concat("provider", F.lit("/"), "model"))


def agent_model_matrix(t: Tables, p: Filters = Filters()) -> DataFrame:
    return dense_grid(_model_label(agent_model_stats(t, p)), "agentId", "label", "totalTokens")


def cost_trend_matrix(t: Tables, p: Filters = Filters(), period: str = "month") -> DataFrame:
    rows = _model_label(cost_trends(t, p, period)).where("period is not null").withColumn("cost", F.col("costUsd").cast("decimal(28,6)"))
    return dense_grid(rows, "period", "label", "cost").select("period", "label", F.col("cost").cast("double").alias("costUsd"))


def model_token_matrix(t: Tables, p: Filters = Filters(), bucket: str = "1h") -> DataFrame:
    rows = _model_label(timeseries_models(t, p, bucket)).where("time is not null").withColumn("tokens", F.expr(" + ".join(TOKEN_NAMES)))
    return dense_grid(rows, "time", "label", "tokens")
