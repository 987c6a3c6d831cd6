
RUNS = ("agent_runs", "sessions", "subagent_runs")
CALLS = ("llm_calls", "tool_calls", "mcp_calls")

# Every place that can name a run's agent, by rank; the set name of lowest rank counts.
RUN_AGENTS = """agent_sources AS (
  SELECT instance_id, run_id, 1 AS place, agent_id AS name FROM agent_runs
  UNION ALL BY NAME SELECT 2 AS place, subagent_id AS run_id, agent_id AS name, instance_id FROM subagent_runs
  UNION ALL BY NAME SELECT 3 AS place, run_id, owner.agent_id AS name, instance_id FROM agent_runs SEMI JOIN sessions USING (instance_id, session_id)
    INNER JOIN sessions AS owner USING (instance_id, session_id)),
agent_of_run AS (SELECT instance_id, run_id, arg_min(name, place) AS name FROM agent_sources WHERE length(name) > 0 GROUP BY ALL),
run_agents AS (SELECT run.* REPLACE (ifnull(name, 'unknown') AS agent_id) FROM agent_runs AS run LEFT JOIN agent_of_run USING (instance_id, run_id))"""

# One row per call of any kind; columns that a kind lacks are null.
EVERY_CALL = """every_call AS (
  FROM (SELECT *, 'llm' AS kind, call_id AS id, model AS title FROM llm_calls)
  UNION ALL BY NAME SELECT *, 'tool' AS kind, tool_call_id AS id, tool_name AS title FROM tool_calls
  UNION ALL BY NAME SELECT *, 'mcp' AS kind, call_id AS id, tool_name AS title FROM mcp_calls)"""

TOOL_EVENTS = """tool_events AS (
  SELECT kind AS source, CASE WHEN length(title) > 0 THEN title ELSE 'unknown' END AS tool, instance_id, run_id, session_id, status, duration_ms, started_at, error_category, attempt, retry_reason
  FROM every_call WHERE kind IN ('tool', 'mcp'))"""

# Failures meet the agent of their run once, runs themselves included; system events have none.
ERROR_EVENTS = """failures AS (
  FROM (SELECT kind, instance_id, run_id, error_category, started_at, duration_ms FROM every_call WHERE status = 'failed')
  UNION ALL BY NAME SELECT 'run' AS kind, instance_id, run_id, error_category, started_at, duration_ms FROM agent_runs WHERE status = 'failed'),
error_events AS (
  SELECT f.kind, f.instance_id, ifnull(run.agent_id, 'unknown') AS agent_id, CASE WHEN length(f.error_category) > 0 THEN f.error_category ELSE 'unknown' END AS category, f.started_at, f.duration_ms
  FROM failures AS f LEFT JOIN run_agents AS run ON (f.instance_id, f.run_id) = (run.instance_id, run.run_id)
  UNION ALL BY NAME SELECT 'system' AS kind, 'unknown' AS agent_id, instance_id, event_type AS category, occurred_at AS started_at FROM ledger
    WHERE list_contains(['gateway.crashed', 'monitor.events_dropped', 'monitor.plugin_error'], event_type))"""
