"""Headline numbers, counters, alerts, rollups and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, counters, retention, summary
from ..operators.counters import HoldRule
from ..operators.filters import Filters
from ..operators.summary import Thresholds
from ..sources.adapter import NOW_EVENTS, NOW_ORDERS
from .queries_charts import AGENTS, MODELS, POINTS_CTE
from .queries_ledger import instances_sql
from .queries_lists import TOTALS
from .queries_stats import ALL_CALLS, NAMED, SUMS, TOOL_RANKED, RETRIES
from .registry import query
from .shared import CALLS, ERROR_EVENTS, RUN_AGENTS, RUNS, TOOL_EVENTS

ALL = (*ALL_CALLS, "retry_events")
HOST = (*ALL_CALLS, "resource_samples", "ledger")
INSTANCES = instances_sql("ledger")
TOOLS = "tools AS (" + ("WITH " + TOOL_RANKED.format(head="", where="TRUE", keys="source, tool", out="source, tool", tail=RETRIES).strip().lstrip(",").strip()) + ")"
AGG = """ag AS (SELECT count(*) n, sum(runs) runs, sum("runErrors") re, sum("completedRuns") cr, sum("llmRequests") lr, sum("llmErrors") le, sum("totalTokens") tt, sum("toolCalls") tc, sum("toolErrors") te,
  sum("costUsd"::DECIMAL(28,6))::DOUBLE cost, sum("inputTokens") it, sum("outputTokens") ot, sum("cacheReadTokens") crt, sum("cacheWriteTokens") cwt, sum("llmDurationMs") ld, sum("toolDurationMs") td FROM agents)"""
LAST = """lp AS (SELECT coalesce(arg_max("diskUsedPercent", time) FILTER (WHERE "diskTotalBytes">0),0) d, coalesce(arg_max("maxMemoryBytes", time) FILTER (WHERE "maxMemoryBytes">0),0) m, coalesce(arg_max("averageCpuPercent", time) FILTER (WHERE "averageCpuPercent">0),0) c FROM points)"""


def lev(v, w=5, c=15):
    return f"CASE WHEN {v}>={c} THEN 'critical' WHEN {v}>={w} THEN 'warning' ELSE '' END"


def items(source, pairs):
    return " UNION ALL ".join(f"SELECT '{k}' AS id, ({v})::DOUBLE AS value, {l or chr(39) * 2} AS level FROM {source}" for k, v, l in pairs)


ER = "1e2*re/runs"
query("kpis", lambda t: summary.kpis(t, bucket="1d"), HOST, items("ag", [
    ("runs", "runs", lev(ER)), ("llmRequests", "lr", None), ("totalTokens", "tt", None), ("toolCalls", "tc", None), ("avgLlmLatency", "ld/lr", lev("ld/lr", 5000, 15000)), ("cost", "cost", None),
    ("inputTokens", "it", None), ("outputTokens", "ot", None), ("cacheReadTokens", "crt", None), ("cacheWriteTokens", "cwt", None), ("llmErrors", "le", lev("1e2*le/lr")), ("runErrors", "re", lev(ER)),
    ("toolErrors", "te", None), ("errorRate", ER, lev(ER)), ("toolDuration", "td", None), ("agentCount", "n", None)]) + " UNION ALL " + items("lp", [("diskUsage", "d", None), ("maxMemory", "m", None), ("avgCpu", "c", None)])
    + " UNION ALL " + items("llm_calls", [("lifetimeTokens", "sum(input_tokens+output_tokens+cache_read_tokens+cache_write_tokens)", None), ("lifetimeCost", "sum(cost_usd)", None)])
    + " UNION ALL " + items("sessions", [("activeSessions", "count(*) FILTER (WHERE status='active')", None)]),
    (RUN_AGENTS, TOOL_EVENTS, AGENTS, AGG, POINTS_CTE, LAST))
FIVE = """five AS (SELECT count(*) n, coalesce(bool_or("averageCpuPercent">0),false) s, coalesce(bool_or(runs>0 OR "llmRequests">0),false) b, coalesce(bool_or(runs>0 OR "llmRequests">0 OR "toolCalls">0),false) a FROM (SELECT * FROM points ORDER BY time DESC LIMIT 5))"""
query("overview_summary", lambda t: summary.overview_summary(t, NOW_EVENTS, bucket="1d"), HOST, items("ag", [
    ("runs", "runs", None), ("successRate", "1e2*cr/runs", None), ("totalTokens", "tt", None), ("cost", "cost", None), ("errors", "re+le+te", "CASE WHEN re+le+te>0 THEN 'critical' ELSE '' END"), ("llmRequests", "lr", None),
    ("avgLatency", "ld/lr", None), ("toolCalls", "tc", None), ("cacheRate", "1e2*crt/tt", None), ("inputTokens", "it", None), ("outputTokens", "ot", None), ("errorRate", ER, None)])
    + " UNION ALL " + items("lp", [("diskUsage", "d", None), ("memoryUsage", "m", None)]) + " UNION ALL " + items("five", [("dataFlow", "(b OR NOT s)::INT", "CASE WHEN b OR NOT s THEN '' ELSE 'critical' END")])
    + " UNION ALL " + items("sessions WHERE status='active'", [("onlineAgents", "count(DISTINCT nullif(agent_id,''))", None), ("activeSessions", "count(*)", None)])
    + " UNION ALL " + items(f"(SELECT round((epoch_ms(TIMESTAMP '{NOW_EVENTS}')-epoch_ms(max(received_at)))/60000.0::DOUBLE)<10 AS h FROM ledger)", [("daemonHealth", "h::INT", "CASE WHEN h THEN '' ELSE 'critical' END")]),
    (RUN_AGENTS, TOOL_EVENTS, AGENTS, AGG, POINTS_CTE, LAST, FIVE))
query("agent_overview", lambda t: summary.agent_overview(t), ALL_CALLS, """
, s AS (SELECT agent_id AS "agentId", count(*) FILTER (WHERE status='active') a, count(*) n FROM sessions GROUP BY 1)
SELECT "agentId", CASE WHEN coalesce(a,0)>0 THEN 'active' WHEN "runErrors">0 THEN 'degraded' ELSE 'idle' END AS state, coalesce(a,0) AS "activeSessions", coalesce(n,0) AS sessions, runs, "successRate", "totalTokens", "costUsd",
  "costUsd"/greatest(1,"completedRuns") AS "costPerCompletedRun", "averageDurationMs" FROM agents LEFT JOIN s USING ("agentId")
""", (RUN_AGENTS, TOOL_EVENTS, AGENTS))
query("session_summary", lambda t: summary.session_summary(t, NOW_ORDERS), ("sessions",), f"""
, d AS (SELECT *, coalesce(greatest(0, epoch_ms(coalesce(ended_at, TIMESTAMP '{NOW_ORDERS}'))-epoch_ms(started_at)),0)::DOUBLE AS took FROM sessions)
SELECT count(*) AS total, count(*) FILTER (WHERE status='active') AS active, sum(message_count)::BIGINT AS messages, quantile_disc(took, 0.5) AS p50, quantile_disc(took, 0.9) AS p90, quantile_disc(took, 0.99) AS p99 FROM d
""")
query("model_summary", lambda t: summary.model_summary(t), ALL_CALLS, """
SELECT count(*) AS models, sum(requests)::BIGINT AS requests, sum(errors)::BIGINT AS errors, sum("inputTokens"+"outputTokens"+"cacheReadTokens"+"cacheWriteTokens")::BIGINT AS "totalTokens", sum("outputTokens")::BIGINT AS "outputTokens",
  sum("cacheReadTokens"+"cacheWriteTokens")::BIGINT AS "cacheTokens", sum("costUsd"::DECIMAL(28,6))::DOUBLE AS cost, sum((coalesce("averageDurationMs",0)*requests)::DECIMAL(38,6))::DOUBLE/sum(requests) AS "averageDurationMs",
  1e2*0+sum(("successRate"*requests)::DECIMAL(38,6))::DOUBLE/sum(requests) AS "successRate" FROM models
""", (RUN_AGENTS, MODELS))
query("tool_summary", lambda t: summary.tool_summary(t), ALL_CALLS, """
SELECT count(*) AS tools, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, sum(("successRate"*calls)::DECIMAL(38,6))::DOUBLE/sum(calls) AS "successRate", sum((coalesce("averageDurationMs",0)*calls)::DECIMAL(38,6))::DOUBLE/sum(calls) AS "averageDurationMs",
  quantile_disc(coalesce("p95DurationMs",0), 0.95) AS "p95DurationMs", quantile_disc(coalesce("p99DurationMs",0), 0.99) AS "p99DurationMs", sum(timeouts)::BIGINT AS timeouts, sum(retries)::BIGINT AS retries FROM tools
""", (RUN_AGENTS, TOOL_EVENTS, TOOLS))
query("infra_summary", lambda t: summary.infra_summary(t, bucket="1d"), HOST, """
SELECT time, "averageCpuPercent" AS "cpuPercent", "averageMemoryBytes"/1048576.0::DOUBLE AS "memoryMiB", "diskUsedPercent" FROM points WHERE "diskTotalBytes">0 OR "averageMemoryBytes">0 ORDER BY time DESC LIMIT 1
""", (RUN_AGENTS, TOOL_EVENTS, POINTS_CTE))

FORECAST_NOW = "2001-10-20 00:00:00"
TREND30 = f"""t30 AS (SELECT strftime(l.started_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS period, coalesce(r.agent_id,'unknown') AS agent, cost_usd FROM llm_calls l LEFT JOIN run_agents r ON r.instance_id=l.instance_id AND r.run_id=l.run_id
  WHERE l.started_at BETWEEN TIMESTAMP '{FORECAST_NOW}' - INTERVAL 30 DAY AND TIMESTAMP '{FORECAST_NOW}')"""
query("cost_forecast", lambda t: summary.cost_forecast(t, FORECAST_NOW, 5000000), ALL_CALLS, """
, a AS (SELECT sum(cost_usd)::DOUBLE AS c, count(DISTINCT period) AS n FROM t30)
SELECT c AS "rollingCost", n AS days, c/n AS "averageDaily", c/n*31 AS forecast, 1e2*(c/n*31)/5000000::DOUBLE AS "budgetPercent", CASE WHEN 1e2*(c/n*31)/5000000::DOUBLE>=100 THEN 'critical' WHEN 1e2*(c/n*31)/5000000::DOUBLE>=80 THEN 'warning' ELSE '' END AS level FROM a
""", (RUN_AGENTS, TREND30))
query("cost_top_agents", lambda t: summary.cost_top_agents(t, FORECAST_NOW, top=5), ALL_CALLS, """SELECT agent AS "agentId", sum(cost_usd)::DOUBLE AS "costUsd" FROM t30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""", (RUN_AGENTS, TREND30))
query("cost_top_sessions", lambda t: summary.cost_top_sessions(t), ALL, """
SELECT s.instance_id AS "instanceId", s.session_id AS "sessionId", coalesce(nullif(agent_id,''),'unknown') AS "agentId", "costUsd", "totalTokens" FROM sessions s JOIN totals USING (instance_id, session_id) WHERE "costUsd">0 ORDER BY "costUsd" DESC, s.session_id, s.instance_id LIMIT 12
""", (TOOL_EVENTS, TOTALS))
query("cost_by_model", lambda t: summary.cost_by_model(t), ALL_CALLS, f"""
, m AS (SELECT {NAMED}, count(*) AS requests, sum(cost_usd)::DOUBLE AS c FROM llm_calls l GROUP BY 1,2)
SELECT provider, model, requests, c AS "costUsd", c/requests AS "averageCost", 1e2*c/(SELECT sum(cost_usd)::DOUBLE FROM llm_calls) AS "percentOfTotal" FROM m
""")
query("budget_status", lambda t: summary.budget_status(t, FORECAST_NOW, 5000000), ALL_CALLS, f"""
, a AS (SELECT sum(cost_usd) FILTER (WHERE started_at>=TIMESTAMP '{FORECAST_NOW}' - INTERVAL 30 DAY)::DOUBLE AS c FROM llm_calls)
SELECT c AS "lastMonthCost", 5000000::DOUBLE AS budget, least(100, 1e2*c/5000000::DOUBLE) AS "usedPercent", {lev('least(100, 1e2*c/5000000::DOUBLE)', 80, 100)} AS level, greatest(0, 5000000::DOUBLE-c) AS remaining FROM a
""")
HEAT = """, h AS (SELECT time_bucket(INTERVAL '1 day', started_at) AS time, agent_id AS a, count(*) AS runs FROM run_agents WHERE started_at IS NOT NULL GROUP BY 1,2),
f AS (SELECT epoch_ms(min(time)) AS lo, (epoch_ms(max(time))-epoch_ms(min(time)))/24.0::DOUBLE AS w FROM h),
c AS (SELECT a, floor(lo+(least(23, greatest(0, floor((epoch_ms(time)-lo)/w)))+0.5::DOUBLE)*w)::BIGINT AS ms, sum(runs)::BIGINT AS runs FROM h, f GROUP BY 1,2)
SELECT a AS "agentId", make_timestamp(ms*1000) AS "slotTime", runs, runs/(SELECT max(runs) FROM c)::DOUBLE AS intensity FROM c"""
query("activity_heatmap", lambda t: summary.activity_heatmap(t, bucket="1d"), RUNS, HEAT, (RUN_AGENTS,))
query("tool_agent_matrix", lambda t: summary.tool_agent_matrix(t, bucket="1d"), ALL_CALLS, """
, e AS (SELECT time_bucket(INTERVAL '1 day', e.started_at) AS time, e.source, e.tool, coalesce(r.agent_id,'unknown') AS agent, count(*) AS calls FROM tool_events e LEFT JOIN run_agents r ON r.instance_id=e.instance_id AND r.run_id=e.run_id WHERE e.started_at IS NOT NULL GROUP BY 1,2,3,4),
o AS (SELECT *, row_number() OVER (ORDER BY time, calls DESC, source, tool, agent) AS pos FROM e), c AS (SELECT agent, tool, sum(calls)::BIGINT AS calls FROM e GROUP BY 1,2),
ta AS (SELECT agent FROM o GROUP BY 1 ORDER BY min(pos) LIMIT 12), tt AS (SELECT tool FROM o GROUP BY 1 ORDER BY min(pos) LIMIT 18)
SELECT agent AS "agentId", tool, calls, calls/(SELECT max(calls) FROM c)::DOUBLE AS intensity FROM c WHERE agent IN (SELECT agent FROM ta) AND tool IN (SELECT tool FROM tt)
""", (RUN_AGENTS, TOOL_EVENTS))
query("tool_share", lambda t: summary.tool_share(t), ALL_CALLS, """
, c AS (SELECT source, tool, count(*) AS n FROM tool_events GROUP BY 1,2), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source, tool) AS rk FROM c)
SELECT CASE WHEN rk<=7 THEN concat(source,':',tool) ELSE 'Other' END AS label, sum(n)::BIGINT AS calls, 1e2*sum(n)/(SELECT max(n) FROM c) AS "relativePercent" FROM r GROUP BY 1
""", (TOOL_EVENTS,))
query("token_share", lambda t: summary.token_share(t), ALL_CALLS, """SELECT concat(provider,'/',model) AS label, "inputTokens"+"outputTokens"+"cacheReadTokens"+"cacheWriteTokens" AS "totalTokens" FROM models""", (RUN_AGENTS, MODELS))
query("latency_scatter", lambda t: summary.latency_scatter(t, Filters(limit=200)), ALL_CALLS, """
SELECT call_id AS "callId", concat(coalesce(nullif(provider,''),'unknown'),'/',coalesce(nullif(model,''),'unknown')) AS series, (input_tokens+output_tokens+cache_read_tokens+cache_write_tokens)::DOUBLE AS x, coalesce(duration_ms,0) AS y
FROM llm_calls ORDER BY coalesce(started_at, ended_at) DESC, call_id DESC, instance_id DESC LIMIT 200
""")


def dense(cat, cte):
    return f", cells AS ({cte}) SELECT c.c AS {cat}, s.s AS label, coalesce(v,0) AS {{value}} FROM (SELECT DISTINCT c FROM cells) c CROSS JOIN (SELECT DISTINCT s FROM cells) s LEFT JOIN cells ON cells.c=c.c AND cells.s=s.s"


LABEL = "concat(coalesce(nullif(provider,''),'unknown'),'/',coalesce(nullif(model,''),'unknown'))"
query("model_token_grid", lambda t: summary.model_token_matrix(t, bucket="1d"), ("llm_calls",), dense("time", f"SELECT time_bucket(INTERVAL '1 day', started_at) AS c, {LABEL} AS s, sum(input_tokens+output_tokens+cache_read_tokens+cache_write_tokens)::BIGINT AS v FROM llm_calls WHERE started_at IS NOT NULL GROUP BY 1,2").format(value="tokens"))
query("agent_model_grid", lambda t: summary.agent_model_matrix(t), ALL_CALLS, dense('"agentId"', f"SELECT r.agent_id AS c, {LABEL.replace('provider', 'l.provider').replace('model,', 'l.model,')} AS s, sum(input_tokens+output_tokens+cache_read_tokens+cache_write_tokens)::BIGINT AS v FROM llm_calls l JOIN run_agents r ON r.instance_id=l.instance_id AND r.run_id=l.run_id GROUP BY 1,2").format(value='"totalTokens"'), (RUN_AGENTS,))
query("cost_trend_grid", lambda t: summary.cost_trend_matrix(t), ALL_CALLS, dense("period", f"SELECT strftime(started_at + INTERVAL 8 HOUR, '%Y-%m') AS c, {LABEL} AS s, sum(cost_usd)::DOUBLE AS v FROM llm_calls WHERE started_at IS NOT NULL GROUP BY 1,2").format(value='"costUsd"'))

# --- counters ----------------------------------------------------------------------------------

LABELS = ["instance", "status"]
DELTA = """prev AS (SELECT *, lag(value) OVER (PARTITION BY metric, instance, status ORDER BY ts, value) AS b FROM metric_samples),
dl AS (SELECT *, CASE WHEN value<b THEN value ELSE value-b END AS d FROM prev WHERE b IS NOT NULL)"""


def at_grid(step, rng, source):
    """Rows of ``source`` at every step instant whose look-back holds them."""
    return f"(SELECT s.*, make_timestamp((a*1000000)::BIGINT) AS \"at\" FROM (SELECT *, unnest(range((ceil(epoch_us(ts)/{step}000000.0::DOUBLE)*{step})::BIGINT, (ceil(epoch_us(ts)/{step}000000.0::DOUBLE)*{step})::BIGINT+{rng}, {step})) AS a FROM {source}) s)"


COUNTER = ("metric_samples",)
query("counter_increase", lambda t: counters.counter_increase(t.metric_samples.where("metric <> 'resident_memory_bytes'"), LABELS, 3600, 900, ["status"]), COUNTER,
      f"SELECT metric, status, \"at\", sum(d) AS increase FROM {at_grid(900, 3600, 'dl')} WHERE metric<>'resident_memory_bytes' GROUP BY 1,2,3", (DELTA,))
query("counter_rate", lambda t: counters.counter_rate(t.metric_samples.where("metric <> 'resident_memory_bytes'"), LABELS, 3600, 1800), COUNTER,
      f"SELECT metric, instance, status, \"at\", sum(d)/3600.0::DOUBLE AS rate FROM {at_grid(1800, 3600, 'dl')} WHERE metric<>'resident_memory_bytes' GROUP BY 1,2,3,4", (DELTA,))
query("error_ratio", lambda t: counters.error_ratio(t.metric_samples, LABELS, 7200, 3600, "llm_requests_total", F.col("status") == "failed"), COUNTER,
      f"SELECT \"at\", (sum(CASE WHEN status='failed' THEN d ELSE 0 END)/7200.0::DOUBLE)/greatest(sum(d)/7200.0::DOUBLE, 0.001::DOUBLE) AS ratio FROM {at_grid(3600, 7200, 'dl')} WHERE metric='llm_requests_total' GROUP BY 1", (DELTA,))
query("gauge_latest", lambda t: counters.gauge_latest(t.metric_samples, LABELS), COUNTER, """
SELECT metric, status, sum(v) AS total, max(v) AS top FROM (SELECT metric, instance, status, arg_max(value, (ts, value)) AS v FROM metric_samples GROUP BY 1,2,3) GROUP BY 1,2
""")
query("availability", lambda t: counters.min_over_time(t.up_samples, LABELS, 7200, 3600).drop("status"), ("up_samples",), f"SELECT metric, instance, \"at\", min(value) AS value FROM {at_grid(3600, 7200, 'up_samples')} GROUP BY 1,2,3")
HIST = """hb AS (SELECT coalesce(nullif(provider,''),'unknown') AS provider, coalesce(nullif(model,''),'unknown') AS model, status, duration_ms/1e3 AS s FROM llm_calls WHERE duration_ms IS NOT NULL),
les(le) AS (VALUES (0.1::DOUBLE),(0.5),(1.0),(2.5),(5.0),(10.0),(30.0),(60.0),(120.0),('inf'::DOUBLE)),
hist AS (SELECT provider, model, status, le, sum((s<=le)::INT)::BIGINT AS count FROM hb CROSS JOIN les GROUP BY 1,2,3,4)"""
query("duration_histogram", lambda t: counters.duration_histogram(t), ("llm_calls",), "SELECT provider, model, status, le, count FROM hist", (HIST,))
query("histogram_quantile", lambda t: counters.histogram_quantile(counters.duration_histogram(t), 0.5, ["provider"]), ("llm_calls",), """
, c AS (SELECT provider, le, sum(count) AS n, max(sum(count)) OVER (PARTITION BY provider) AS total FROM hist GROUP BY 1,2),
w AS (SELECT *, lag(le,1,0::DOUBLE) OVER (PARTITION BY provider ORDER BY le) AS lo, lag(n,1,0) OVER (PARTITION BY provider ORDER BY le) AS below FROM c)
SELECT provider, CASE WHEN le='inf'::DOUBLE THEN 120 ELSE lo+(le-lo)*(total*0.5::DOUBLE-below)/(n-below) END AS seconds FROM w WHERE n>=total*0.5::DOUBLE AND below<total*0.5::DOUBLE
""", (HIST,))
query("slowest_tools", lambda t: counters.slowest_tools(t, 10), ALL_CALLS, """
SELECT source, tool, count(*) AS calls, avg(duration_ms) AS "averageDurationMs" FROM tool_events GROUP BY 1,2 ORDER BY 4 DESC, 1, 2 LIMIT 10
""", (TOOL_EVENTS,))
RULES = (HoldRule("gateway_down", "gauge", "gateway_up", "critical", 0, 3600, look_back=3600, below=True, by=("instance",)),
         HoldRule("high_memory", "gauge", "resident_memory_bytes", "warning", 2147483648, 7200, look_back=7200, by=("instance",)),
         HoldRule("high_llm_error_rate", "ratio", "llm_requests_total", "warning", 0.4, 3600, look_back=3600),
         HoldRule("tool_error_spike", "increase", "tool_errors_total", "warning", 300, 1800, look_back=3600),
         HoldRule("dropping_events", "increase", "events_dropped_total", "warning", 500, 1800, look_back=3600))


def rule_samples(t):
    return t.metric_samples.unionByName(t.up_samples)


query("alert_rule_firings", lambda t: counters.alert_rules(rule_samples(t), LABELS, RULES, 900), ("metric_samples", "up_samples"), f"""
, allsamples AS (SELECT * FROM metric_samples UNION ALL SELECT * FROM up_samples),
ga AS (SELECT metric, instance, status, "at", arg_max(value, (ts, value)) AS v FROM {at_grid(900, 3600, 'allsamples')} WHERE metric='gateway_up' GROUP BY 1,2,3,4),
gm AS (SELECT metric, instance, status, "at", arg_max(value, (ts, value)) AS v FROM {at_grid(900, 7200, 'allsamples')} WHERE metric='resident_memory_bytes' GROUP BY 1,2,3,4),
inc AS (SELECT metric, status, "at", sum(d) AS d FROM {at_grid(900, 3600, 'dl')} GROUP BY 1,2,3),
hit AS (SELECT DISTINCT 'gateway_down' AS rule, 'critical' AS severity, instance, 3600 AS hold, "at" FROM ga WHERE v=0
  UNION ALL SELECT DISTINCT 'high_memory', 'warning', instance, 7200, "at" FROM gm WHERE v>2147483648
  UNION ALL SELECT 'high_llm_error_rate', 'warning', '', 3600, "at" FROM inc WHERE metric='llm_requests_total' GROUP BY "at" HAVING (sum(CASE WHEN status='failed' THEN d ELSE 0 END)/3600.0::DOUBLE)/greatest(sum(d)/3600.0::DOUBLE,0.001::DOUBLE)>0.4::DOUBLE
  UNION ALL SELECT 'tool_error_spike', 'warning', '', 1800, "at" FROM inc WHERE metric='tool_errors_total' GROUP BY "at" HAVING sum(d)>300
  UNION ALL SELECT 'dropping_events', 'warning', '', 1800, "at" FROM inc WHERE metric='events_dropped_total' GROUP BY "at" HAVING sum(d)>500),
isl AS (SELECT *, "at" - INTERVAL 900 SECOND * row_number() OVER (PARTITION BY rule, instance ORDER BY "at") AS g FROM hit)
SELECT rule, severity, instance, min("at") AS active_at, min("at") + INTERVAL 1 SECOND * hold AS fired_at, max("at") AS last_at FROM isl GROUP BY rule, severity, instance, hold, g HAVING max("at") >= min("at") + INTERVAL 1 SECOND * hold
""", (DELTA,))

# --- alerts --------------------------------------------------------------------------------------

LIMITS = Thresholds(error_rate_warning=20, error_rate_critical=34, llm_latency_warning_ms=54000, llm_latency_critical_ms=56000, tool_p99_warning_ms=100000, tool_p99_critical_ms=104000,
                    session_stuck_ms=1.9e11, cost_budget_usd=3000000)
ALERT_NOW = "2001-10-20 00:00:00"


def rule_sql(source, ident, kind, target, value, warning, critical, where="TRUE", at="NULL"):
    return f"SELECT {ident} AS id, CASE WHEN {value}>={critical} THEN 'critical' ELSE 'warning' END AS severity, {kind} AS source, {target} AS target, ({value})::DOUBLE AS value, {at}::TIMESTAMP AS \"occurredAt\" FROM {source} WHERE {where} AND {value}>={warning}"


STALE = f"""stale AS (SELECT 'stream' AS subject, 'event-stream' AS id, (epoch_ms(TIMESTAMP '{{now}}')-epoch_ms(max(received_at)))/60000.0::DOUBLE AS age, max(received_at) AS "at", 10 AS w, 30 AS c FROM ledger
  UNION ALL SELECT 'instance', instance_id, (epoch_ms(TIMESTAMP '{{now}}')-epoch_ms(last_seen_at))/60000.0::DOUBLE, last_seen_at, 5, 15 FROM instances WHERE status='up')"""
ALERTS = "alerts AS (" + " UNION ALL ".join([
    rule_sql("agents", "concat('agent-error:',\"agentId\")", "'agent'", '"agentId"', '"errorRate"', 20, 34, "runs>=3"),
    rule_sql("models", "concat('model-error:',provider,':',model)", "'model'", "model", '"errorRate"', 20, 34, "requests>=3"),
    rule_sql("models", "concat('model-latency:',provider,':',model)", "'model'", "model", '"averageDurationMs"', 54000, 56000, "requests>=3"),
    rule_sql("tools", "concat('tool-error:',source,':',tool)", "source", "tool", '"failureRate"', 20, 34, "calls>=3"),
    rule_sql("tools", "concat('tool-latency:',source,':',tool)", "source", "tool", '"p99DurationMs"', 100000, 104000, "calls>=3"),
    rule_sql(f"(SELECT *, (epoch_ms(TIMESTAMP '{ALERT_NOW}')-epoch_ms(started_at))::DOUBLE AS age FROM sessions WHERE status='active')", "concat_ws(':','session-stuck',instance_id,session_id)", "'session'", "session_id", "age", "1.9e11", "3.8e11", at="started_at"),
    "SELECT concat('system:',event_id), 'critical', 'system', event_id, NULL, occurred_at FROM ledger WHERE event_type IN ('gateway.crashed','monitor.events_dropped','monitor.plugin_error')",
    rule_sql(f"(SELECT sum(cost_usd) FILTER (WHERE started_at>=TIMESTAMP '{ALERT_NOW}' - INTERVAL 30 DAY)::DOUBLE AS c FROM llm_calls)", "'cost-budget:monthly'", "'cost'", "'monthly'", "c", 2400000, 3000000),
    "SELECT CASE subject WHEN 'stream' THEN 'stream:event-stale' ELSE concat('instance:stale:',id) END, CASE WHEN age>=c THEN 'critical' ELSE 'warning' END, 'system', id, age, CASE subject WHEN 'stream' THEN \"at\" END FROM stale WHERE age>=w",
    "SELECT 'stream:data-flow-stall', 'critical', 'system', 'event-stream', NULL, NULL FROM five WHERE n>=5 AND s AND NOT a",
    "SELECT concat('instance:down:',instance_id), 'critical', 'system', instance_id, NULL, NULL FROM instances WHERE status IN ('stopped','crashed')"]) + ")"
ALERT_CTES = (RUN_AGENTS, TOOL_EVENTS, AGENTS, MODELS, TOOLS, POINTS_CTE, FIVE, INSTANCES, STALE.replace("{now}", ALERT_NOW), ALERTS)


def all_alerts(t):
    return alerts.evaluate_alerts(t, ALERT_NOW, limits=LIMITS, bucket="1d")


query("alerts", all_alerts, HOST, "SELECT * FROM alerts", ALERT_CTES)


def alert_state(t):
    """What users did with alerts: a third acknowledged, a third silenced, by the alert's digest."""
    digit = F.conv(F.substring(F.md5("id"), 1, 1), 16, 10).cast("int") % 3
    until = F.when(F.col("severity") == "critical", F.lit("2001-10-21 00:00:00")).otherwise(F.lit("2001-10-19 00:00:00")).cast("timestamp")
    return all_alerts(t).where(digit < 2).select("id", (digit == 0).alias("acknowledged"), F.when(digit == 1, until).alias("silenced_until"))


STATE = """st AS (SELECT *, strpos('0123456789abcdef', substr(md5(id),1,1))-1 AS dg FROM alerts),
stated AS (SELECT *, dg%3=0 AS ack, CASE WHEN dg%3=1 THEN CASE severity WHEN 'critical' THEN TIMESTAMP '2001-10-21' ELSE TIMESTAMP '2001-10-19' END END AS su FROM st)"""
query("alert_state", lambda t: alerts.apply_alert_state(all_alerts(t), alert_state(t), ALERT_NOW), HOST, f"""
SELECT id, severity, source, target, value, "occurredAt", ack AS acknowledged, su AS "silencedUntil", coalesce(su>TIMESTAMP '{ALERT_NOW}', false) AS silenced FROM stated
""", (*ALERT_CTES, STATE))
query("error_summary", lambda t: summary.error_summary(t, alerts.apply_alert_state(all_alerts(t), alert_state(t), ALERT_NOW)), HOST, f"""
SELECT count(*) FILTER (WHERE kind='run') AS "agentErrors", count(*) FILTER (WHERE kind='llm') AS "llmErrors", count(*) FILTER (WHERE kind IN ('tool','mcp')) AS "toolErrors", count(*) FILTER (WHERE kind='system') AS "systemErrors",
  count(DISTINCT (kind, category)) AS categories, (SELECT count(*) FROM stated WHERE NOT ack AND NOT coalesce(su>TIMESTAMP '{ALERT_NOW}', false)) AS "openAlerts", (SELECT count(*) FROM stated WHERE severity='critical') AS "criticalAlerts" FROM error_events
""", (*ALERT_CTES, STATE, ERROR_EVENTS))
query("staleness", lambda t: alerts.staleness(t, "2024-01-31 00:10:00"), ("ledger",), """
SELECT subject, id, age AS "ageMinutes", "at" AS "lastAt", CASE WHEN age>=c THEN 'critical' WHEN age>=w THEN 'warning' ELSE '' END AS severity FROM stale
""", (INSTANCES, STALE.replace("{now}", "2024-01-31 00:10:00")))

# --- rollups and retention -------------------------------------------------------------------------

ROLL = """SELECT instance_id, process_id, {b} AS bucket, count(*) AS samples, avg(resident_memory_bytes) AS resident_memory_bytes, avg(virtual_memory_bytes) AS virtual_memory_bytes, avg(threads) AS threads, avg(open_fds) AS open_fds,
  max(resident_memory_bytes)::BIGINT AS max_resident_memory_bytes, {last} FROM resource_samples {where} GROUP BY 1,2,3"""
LASTS = ", ".join(f"arg_max({c}, (sampled_at, event_id)) AS {c}" for c in ("cpu_seconds_total", "read_bytes", "write_bytes", "disk_total_bytes", "disk_available_bytes"))
for _name, _sec, _sql in (("rollup_1m", 60, "'1 minute'"), ("rollup_15m", 900, "'15 minutes'")):
    query(_name, lambda t, s=_sec: retention.rollup_samples(t.resource_samples, s), ("resource_samples",), ROLL.format(b=f"time_bucket(INTERVAL {_sql}, sampled_at)", last=LASTS, where=""))
AGE = "(epoch(TIMESTAMP '2024-02-15')-floor(epoch(sampled_at)))"
query("tiered_rollup", lambda t: retention.tiered_rollup(t.resource_samples, "2024-02-15 00:00:00").drop("threads"), ("resource_samples",), "SELECT * EXCLUDE (threads) FROM (" + " UNION ALL ".join(
    f"SELECT *, {res} AS resolution FROM (" + ROLL.format(b=b, last=LASTS, where=f"WHERE {cond}") + ")" for res, b, cond in (
        (0, "sampled_at", f"{AGE}<3600"), (60, "time_bucket(INTERVAL '1 minute', sampled_at)", f"{AGE}>=3600 AND {AGE}<86400"),
        (900, "time_bucket(INTERVAL '15 minutes', sampled_at)", f"{AGE}>=86400 AND {AGE}<2592000"), (86400, "time_bucket(INTERVAL '1 day', sampled_at)", f"{AGE}>=2592000"))) + ")")
query("daily_stats", lambda t: retention.daily_stats(t), ALL_CALLS, f"""
SELECT strftime(started_at,'%Y-%m-%d') AS day, instance_id, 'agent' AS dimension_type, agent_id AS dimension_value, count(*) AS requests, count(*) FILTER (WHERE status='failed') AS errors, NULL::BIGINT AS tokens, NULL::DOUBLE AS "costUsd" FROM run_agents WHERE started_at IS NOT NULL GROUP BY 1,2,4
UNION ALL SELECT strftime(started_at,'%Y-%m-%d'), instance_id, 'model', {LABEL}, count(*), count(*) FILTER (WHERE status='failed'), sum(input_tokens+output_tokens+cache_read_tokens+cache_write_tokens)::BIGINT, sum(cost_usd)::DOUBLE FROM llm_calls WHERE started_at IS NOT NULL GROUP BY 1,2,4
UNION ALL SELECT strftime(started_at,'%Y-%m-%d'), instance_id, 'tool', concat(source,':',tool), count(*), count(*) FILTER (WHERE status='failed'), NULL, NULL FROM tool_events WHERE started_at IS NOT NULL GROUP BY 1,2,4
""", (RUN_AGENTS, TOOL_EVENTS))
query("retention_plan", lambda t: retention.retention_plan(t, "2000-06-01 00:00:00", retention.Retention(events=7, samples=30, projections=365)), (*ALL, "ledger", "resource_samples"), " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS total, count(*) FILTER (WHERE {time}<TIMESTAMP '2000-06-01' - INTERVAL {days} DAY) AS expired, count(*) FILTER (WHERE {time} IS NULL) AS untimed FROM {'ledger' if n == 'events' else n}"
    for n, (time, days) in retention.rules(retention.Retention(7, 30, 365)).items()))
query("retention_plan_samples", lambda t: retention.retention_plan(t, NOW_EVENTS), ("ledger", "resource_samples"), f"""
SELECT 'events' AS name, count(*) AS total, count(*) FILTER (WHERE occurred_at<TIMESTAMP '{NOW_EVENTS}' - INTERVAL 7 DAY) AS expired, 0::BIGINT AS untimed FROM ledger
UNION ALL SELECT 'resource_samples', count(*), count(*) FILTER (WHERE sampled_at<TIMESTAMP '{NOW_EVENTS}' - INTERVAL 30 DAY), 0 FROM resource_samples
""")
query("backpressure_edges", lambda t: retention.backpressure_transitions(t.ledger), ("ledger",), """
, b AS (SELECT *, json_extract_string(payload,'$.queueDepth')::DOUBLE AS depth, json_extract_string(payload,'$.queueCapacity')::DOUBLE AS capacity FROM ledger WHERE event_type='gateway.heartbeat'),
w AS (SELECT *, depth>=capacity*0.8::DOUBLE AS s, lag(depth>=capacity*0.8::DOUBLE,1,false) OVER (PARTITION BY instance_id ORDER BY received_at, producer_id, sequence, event_id) AS p FROM b WHERE capacity>0)
SELECT event_id, instance_id, occurred_at, CASE WHEN s THEN 'saturated' ELSE 'recovered' END AS edge, depth, capacity FROM w WHERE s<>p
""")
query("cumulative_usage", lambda t: _cumulative(t), HOST, """
SELECT time, sum("inputTokens"+"outputTokens"+"cacheReadTokens"+"cacheWriteTokens") OVER (ORDER BY time)::DOUBLE AS "cumTokens", (sum("costUsd"::DECIMAL(28,6)) OVER (ORDER BY time))::DOUBLE AS "cumCost" FROM points
""", (RUN_AGENTS, TOOL_EVENTS, POINTS_CTE))


def _cumulative(t):
    from ..operators.charts import DATASETS
    return DATASETS["overview"].rows(t, Filters(), "1d", ("time",)).select("time", F.col("cumTokens").cast("double").alias("cumTokens"), "cumCost")
