"""Intake, validation, folds and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics, reduce, validate
from ..schemas import ARRIVAL
from ..sources.adapter import NOW_INTAKE
from .registry import query

CHECKED = f"""checked AS (SELECT *, CASE
  WHEN schema_version IS DISTINCT FROM 1 THEN 'schema_version'
  WHEN event_id IS NULL OR strlen(event_id) NOT BETWEEN 32 AND 64 THEN 'event_id'
  WHEN event_type NOT IN ('gateway.started','gateway.heartbeat','gateway.stopped','gateway.crashed','session.started','session.completed','session.failed','agent.started','agent.completed','agent.failed',
    'llm.started','llm.completed','llm.failed','llm.retried','tool.started','tool.completed','tool.failed','mcp.started','mcp.completed','mcp.failed','subagent.started','subagent.completed','subagent.failed',
    'resource.sampled','monitor.events_dropped','monitor.plugin_error') THEN 'event_type'
  WHEN occurred_at < TIMESTAMP '1970-01-01' OR occurred_at > TIMESTAMP '{NOW_INTAKE}' + INTERVAL 24 HOUR THEN 'occurred_at'
  WHEN NOT regexp_full_match(instance_id, '[A-Za-z0-9._:-]{{1,128}}') OR NOT regexp_full_match(producer_id, '[A-Za-z0-9._:-]{{1,128}}') THEN 'identity'
  WHEN source NOT IN ('plugin','daemon') THEN 'source'
  WHEN process_id IS NOT NULL AND process_id NOT BETWEEN 1 AND 2147483647 THEN 'process_id'
  WHEN substr(payload,1,1) <> '{{' OR NOT json_valid(payload) THEN 'payload'
  WHEN strlen(payload) + 300 > 16384 THEN 'size' END AS reason FROM raw_events)"""
FIRSTS = """led AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at, producer_id, sequence, batch_id) AS copy FROM checked WHERE reason IS NULL) WHERE copy = 1)"""


def valid(t):
    return validate.validate_events(t.raw_events, NOW_INTAKE)[0]


def clean(t, *columns):
    return validate.dedup_events(valid(t), list(columns) or None)


def clean_of(t, *families):
    """First arrivals of some families; other events only take part in the de-duplication, by their id and arrival."""
    columns = ["event_id", "event_type", "occurred_at", "instance_id", *ARRIVAL[:3], "payload"]
    return validate.dedup_events(valid(t), columns, families).where(validate.in_families(*families))


RAW = ("raw_events",)
query("scan_events", lambda t: t.raw_events.groupBy("event_type", "source").agg(
    F.count("*").alias("events"), F.min("occurred_at").alias("first_at"), F.max("received_at").alias("last_at")), RAW, """
SELECT event_type, source, count(*) AS events, min(occurred_at) AS first_at, max(received_at) AS last_at FROM raw_events GROUP BY 1,2
""")
query("validate_events", lambda t: validate.with_reason(t.raw_events, NOW_INTAKE).where("reason is not null").select("event_id", "event_type", "batch_id", "reason"), RAW,
      "SELECT event_id, event_type, batch_id, reason FROM checked WHERE reason IS NOT NULL", (CHECKED,))
query("validate_counts", lambda t: validate.with_reason(t.raw_events, NOW_INTAKE).groupBy("reason").agg(F.count("*").alias("events")), RAW,
      "SELECT reason, count(*) AS events FROM checked GROUP BY 1", (CHECKED,))
query("batch_verdicts", lambda t: validate.batch_verdicts(t.raw_events, NOW_INTAKE), RAW, """
SELECT batch_id, count(*) AS events, count(reason) AS bad, CASE WHEN count(reason)=0 AND count(*) BETWEEN 1 AND 1000 THEN 'accepted' ELSE 'rejected' END AS verdict FROM checked GROUP BY 1
""", (CHECKED,))
query("accepted_events", lambda t: validate.reject_bad_batches(t.raw_events, NOW_INTAKE).groupBy("event_type").agg(F.count("*").alias("events")), RAW, """
SELECT event_type, count(*) AS events FROM checked WHERE batch_id IN (SELECT batch_id FROM checked GROUP BY 1 HAVING count(reason)=0 AND count(*)<=1000) GROUP BY 1
""", (CHECKED,))
query("dedup_events", lambda t: clean(t, "event_id", "event_type", "received_at", "batch_id", "sequence"), RAW,
      "SELECT event_id, event_type, received_at, batch_id, sequence FROM led", (CHECKED, FIRSTS))
query("ingest_report", lambda t: validate.ingest_report(valid(t)), RAW, """
SELECT batch_id, count(*) AS accepted, sum((copy=1)::INT)::BIGINT AS inserted, sum((copy>1)::INT)::BIGINT AS duplicates
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at, producer_id, sequence, batch_id) AS copy FROM checked WHERE reason IS NULL) GROUP BY 1
""", (CHECKED,))
query("sequence_gaps", lambda t: validate.sequence_gaps(clean(t, "producer_id", "sequence")), RAW, """
SELECT producer_id, before+1 AS gap_from, sequence-1 AS gap_to, sequence-before-1 AS missing
FROM (SELECT producer_id, sequence, lag(sequence) OVER (PARTITION BY producer_id ORDER BY sequence) AS before FROM (SELECT DISTINCT producer_id, sequence FROM led)) WHERE sequence > before+1
""", (CHECKED, FIRSTS))
query("time_regressions", lambda t: validate.time_regressions(clean(t, "event_id", "producer_id", "sequence", "occurred_at")), RAW, """
SELECT event_id, producer_id, sequence, occurred_at, latest_before FROM (SELECT *, max(occurred_at) OVER (PARTITION BY producer_id ORDER BY sequence, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_before FROM led)
WHERE occurred_at < latest_before
""", (CHECKED, FIRSTS))
query("priority_counts", lambda t: validate.tag_priority(clean(t, "event_type", "payload")).groupBy("event_type", "priority").agg(F.count("*").alias("events")), RAW, """
SELECT event_type, CASE WHEN event_type='gateway.heartbeat' THEN 'low' WHEN json_extract(payload,'$.accountingUpdate')='true' THEN 'normal'
  WHEN event_type LIKE 'gateway.%' OR event_type LIKE 'monitor.%' OR event_type LIKE '%.completed' OR event_type LIKE '%.failed' THEN 'critical' ELSE 'normal' END AS priority, count(*) AS events
FROM led GROUP BY 1,2
""", (CHECKED, FIRSTS))

CONTRACT = """contract_rows AS (SELECT event_id, CASE l_partkey % 23
    WHEN 0 THEN concat('{"bad-key":', sequence, '}') WHEN 1 THEN concat('{"k":[', repeat('1,', 128), '1]}')
    WHEN 2 THEN concat('{"k":{"', repeat('n', 65), '":1}}') WHEN 3 THEN concat('{"a":[{"b":"', repeat('y', 4097), '"}]}')
    WHEN 4 THEN concat('{"', repeat('n', 65), '":1}') WHEN 5 THEN concat('{"k":[', repeat('1,', 127), '1]}') WHEN 6 THEN concat('{"k":"', repeat('y', 4096), '"}')
    ELSE '{"k":{"m":[1,2]}}' END AS payload, CASE WHEN l_partkey % 29 = 0 THEN -1 ELSE sequence END AS sequence, l_partkey
  FROM (SELECT line_id AS event_id, l_orderkey AS sequence, l_partkey FROM raw_lines))"""


def contract_rows(t):
    key = F.col("l_partkey") % 23
    text = (F.when(key == 0, F.concat(F.lit('{"bad-key":'), F.col("l_orderkey").cast("string"), F.lit("}"))).when(key == 1, F.lit('{"k":[' + "1," * 128 + "1]}"))
            .when(key == 2, F.lit('{"k":{"' + "n" * 65 + '":1}}')).when(key == 3, F.lit('{"a":[{"b":"' + "y" * 4097 + '"}]}'))
            .when(key == 4, F.lit('{"' + "n" * 65 + '":1}')).when(key == 5, F.lit('{"k":[' + "1," * 127 + "1]}")).when(key == 6, F.lit('{"k":"' + "y" * 4096 + '"}'))
            .otherwise(F.lit('{"k":{"m":[1,2]}}')))
    return t.raw_lines.select(F.col("line_id").alias("event_id"), text.alias("payload"),
                              F.when(F.col("l_partkey") % 29 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")).cast("bigint").alias("sequence"))


query("contract_violations", lambda t: validate.contract_check(contract_rows(t)), ("raw_lines",), """
SELECT event_id, 'sequence' AS rule FROM contract_rows WHERE sequence < 0
UNION ALL SELECT event_id, 'payload_key' FROM contract_rows WHERE l_partkey % 23 IN (0, 4)
UNION ALL SELECT event_id, 'array_length' FROM contract_rows WHERE l_partkey % 23 = 1
UNION ALL SELECT event_id, 'key_length' FROM contract_rows WHERE l_partkey % 23 = 2
UNION ALL SELECT event_id, 'string_length' FROM contract_rows WHERE l_partkey % 23 = 3
""", (CONTRACT,))

# --- diagnostics -----------------------------------------------------------------------

DIAG = ("diagnostics",)


def _c(col, n=256):
    return f"nullif(left(regexp_replace({col}, '[\\r\\n\\x00]', ' ', 'g'), {n}), '')"


HASHED = "CASE WHEN length({0}) > 0 THEN concat('sha256:', left(sha256({0}), 24)) END"
AGENT = f"coalesce({_c('agent_id', 128)}, nullif(regexp_extract({_c('session_key')}, '(?i)^agent:([^:]+):', 1), ''))"
DIAG_COLUMNS = ["line_id", "sequence", "event_type", "occurred_at", "priority", "run_id", "session_id", "session_key_hash", "provider", "model", "channel", "agent_id",
                "trace_id", "span_id", "parent_span_id", "attempt", "trigger", "outcome", "call_id", "tool_call_id", "tool_name", "tool_source", "tool_owner",
                "duration_ms", "error_category", "reason", "count", "queue_depth", "queue_capacity"]
query("map_diagnostics", lambda t: diagnostics.map_diagnostics(t.diagnostics).select(*DIAG_COLUMNS), DIAG, f"""
, d AS (SELECT *, type LIKE 'run.%' AS is_run, type LIKE 'model.call.%' AS is_call, type='model.failover' AS is_over, type LIKE 'tool.%' AS is_tool, type LIKE 'diagnostic.%' AS is_host,
  coalesce({_c('tool_call_id')}, concat('event-', seq)) AS tcid FROM diagnostics WHERE type NOT IN ('model.usage', 'session.idle'))
SELECT line_id, seq AS sequence, CASE type WHEN 'run.started' THEN 'agent.started' WHEN 'run.completed' THEN CASE WHEN outcome='completed' THEN 'agent.completed' ELSE 'agent.failed' END
    WHEN 'model.call.started' THEN 'llm.started' WHEN 'model.call.completed' THEN 'llm.completed' WHEN 'model.call.error' THEN 'llm.failed' WHEN 'model.failover' THEN 'llm.retried'
    WHEN 'diagnostic.heartbeat' THEN 'gateway.heartbeat' WHEN 'diagnostic.async_queue.dropped' THEN 'monitor.events_dropped'
    ELSE concat(CASE WHEN tool_source='mcp' THEN 'mcp' ELSE 'tool' END, '.', CASE split_part(type,'.',3) WHEN 'started' THEN 'started' WHEN 'completed' THEN 'completed' ELSE 'failed' END) END AS event_type,
  ts AS occurred_at, CASE WHEN type='diagnostic.heartbeat' THEN 'low' WHEN type IN ('run.completed','model.call.completed','model.call.error','diagnostic.async_queue.dropped','tool.execution.completed','tool.execution.error','tool.execution.blocked') THEN 'critical' ELSE 'normal' END AS priority,
  CASE WHEN NOT is_host THEN {_c('run_id')} END AS run_id, CASE WHEN NOT is_host THEN {_c('session_id')} END AS session_id, CASE WHEN NOT is_host THEN {HASHED.format('session_key')} END AS session_key_hash,
  CASE WHEN NOT is_host THEN provider END AS provider, CASE WHEN NOT is_host THEN model END AS model, CASE WHEN NOT is_host THEN channel END AS channel, CASE WHEN NOT is_host THEN {AGENT} END AS agent_id,
  CASE WHEN NOT is_host THEN coalesce(run_id, session_id) END AS trace_id, CASE WHEN is_run THEN run_id WHEN is_tool THEN tcid WHEN NOT is_host THEN call_id END AS span_id,
  CASE WHEN NOT is_host AND NOT is_run THEN run_id END AS parent_span_id, CASE WHEN is_over THEN coalesce(attempt, 1) WHEN is_call OR is_tool THEN attempt END AS attempt,
  CASE WHEN is_run THEN trigger END AS trigger, CASE WHEN type='run.completed' THEN outcome END AS outcome, CASE WHEN is_call THEN call_id END AS call_id, CASE WHEN is_tool THEN tcid END AS tool_call_id,
  CASE WHEN is_tool THEN coalesce({_c('tool_name', 128)}, 'unknown') END AS tool_name, CASE WHEN is_tool THEN tool_source END AS tool_source, CASE WHEN is_tool THEN tool_owner END AS tool_owner,
  CASE WHEN is_tool OR type IN ('run.completed','model.call.completed','model.call.error') THEN duration_ms END AS duration_ms,
  CASE WHEN is_tool OR type IN ('run.completed','model.call.completed','model.call.error') THEN coalesce(error_category, CASE WHEN type LIKE '%.blocked' THEN 'blocked' END) END AS error_category,
  CASE WHEN type='diagnostic.async_queue.dropped' THEN 'diagnostic_queue' END AS reason, CASE WHEN type='diagnostic.async_queue.dropped' THEN dropped END AS count,
  CASE WHEN is_host THEN queue_depth END AS queue_depth, CASE WHEN type='diagnostic.heartbeat' THEN queue_capacity END AS queue_capacity
FROM d
""")
query("scrub_keys", lambda t: diagnostics.scrub(t.diagnostics).select("line_id", "session_key_hash", "agent_id", "tool_name"), DIAG,
      f"SELECT line_id, {HASHED.format('session_key')} AS session_key_hash, {AGENT} AS agent_id, {_c('tool_name', 128)} AS tool_name FROM diagnostics")
query("usage_attribution", lambda t: diagnostics.attribute_usage(t.diagnostics).drop("accounting_update"), DIAG, f"""
, d AS (SELECT *, {HASHED.format('session_key')} AS kh FROM diagnostics WHERE type IN ('model.usage','model.call.started','model.call.completed','model.call.error')),
k AS (SELECT d.*, 0 AS rank, concat('r', run_id) AS k FROM d WHERE run_id IS NOT NULL UNION ALL SELECT d.*, 1, concat('k', kh) FROM d WHERE kh IS NOT NULL UNION ALL SELECT d.*, 2, concat('s', session_id) FROM d WHERE session_id IS NOT NULL),
w AS (SELECT *, last_value(CASE WHEN type<>'model.usage' THEN line_id END IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts, seq, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lc FROM k),
b AS (SELECT line_id, arg_min(lc, rank) AS lc FROM w WHERE type='model.usage' AND lc IS NOT NULL GROUP BY 1)
SELECT u.line_id, u.seq AS sequence, u.ts AS occurred_at, CASE WHEN c.type='model.call.error' THEN 'llm.failed' ELSE 'llm.completed' END AS event_type, c.call_id AS call_id,
  CASE WHEN c.line_id IS NULL THEN u.run_id ELSE c.run_id END AS run_id, CASE WHEN c.line_id IS NULL THEN u.session_id ELSE c.session_id END AS session_id, CASE WHEN c.line_id IS NULL THEN u.kh ELSE c.kh END AS session_key_hash,
  coalesce(u.provider, c.provider) AS provider, coalesce(u.model, c.model) AS model, u.usage_input AS input_tokens, u.usage_output AS output_tokens,
  u.usage_cache_read AS cache_read_tokens, u.usage_cache_write AS cache_write_tokens, u.cost_usd
FROM d u LEFT JOIN b ON b.line_id=u.line_id LEFT JOIN d c ON c.line_id=b.lc WHERE u.type='model.usage'
""")
query("map_hooks", lambda t: diagnostics.map_hooks(t.hooks), ("hooks",), f"""
, h AS (SELECT *, {HASHED.format('child_session_key')} AS child FROM hooks),
w AS (SELECT *, CASE WHEN hook LIKE 'subagent%' THEN lag(CASE WHEN hook='subagent_spawned' THEN coalesce(run_id, child) END) OVER (PARTITION BY instance_id, child, hook LIKE 'subagent%' ORDER BY ts, seq) END AS held FROM h)
SELECT instance_id, seq AS sequence, CASE hook WHEN 'session_start' THEN 'session.started' WHEN 'session_end' THEN CASE WHEN reason='unknown' THEN 'session.failed' ELSE 'session.completed' END
  WHEN 'subagent_spawned' THEN 'subagent.started' ELSE CASE WHEN outcome IS NOT NULL AND outcome<>'ok' THEN 'subagent.failed' ELSE 'subagent.completed' END END AS event_type, ts AS occurred_at,
  CASE WHEN hook IN ('session_end','subagent_ended') THEN 'critical' ELSE 'normal' END AS priority, CASE WHEN hook LIKE 'session%' THEN session_id END AS session_id,
  CASE WHEN hook LIKE 'session%' THEN {HASHED.format('session_key')} END AS session_key_hash, CASE WHEN hook<>'subagent_ended' THEN agent_id END AS agent_id,
  CASE hook WHEN 'subagent_spawned' THEN coalesce(run_id, child) WHEN 'subagent_ended' THEN coalesce(held, run_id, child) END AS subagent_id,
  CASE WHEN hook LIKE 'subagent%' THEN run_id END AS run_id, CASE WHEN hook='subagent_spawned' THEN parent_run_id END AS parent_run_id, child AS child_session_hash, mode, reason, message_count, outcome
FROM w
""")

# --- folds -----------------------------------------------------------------------------


def _txt(key):
    return f"CASE WHEN json_type(payload,'$.{key}')='VARCHAR' THEN left(json_extract_string(payload,'$.{key}'),512) ELSE '' END"


def _num(key):
    return f"CASE WHEN json_type(payload,'$.{key}') IN ('UBIGINT','BIGINT','DOUBLE') THEN json_extract_string(payload,'$.{key}')::DOUBLE ELSE 0 END"


def _opt(key):
    return f"CASE WHEN json_type(payload,'$.{key}') IS NOT NULL THEN {_num(key)} END"


RANKED = """ev AS (SELECT *, split_part(event_type,'.',1) AS family, split_part(event_type,'.',2) AS state,
  row_number() OVER (ORDER BY received_at, producer_id, sequence, event_id) AS rn FROM led)"""


def _fold(e: reduce.Entity, id_sql: str, extra: str = "") -> str:
    """The checking statement of an entity: last, first and greatest values by arrival rank."""
    cols = [f"coalesce(arg_max(nullif({_txt(k)},''), rn) FILTER (WHERE {_txt(k)}<>''),'') AS {c}" for c, k in e.texts.items()]
    cols += [f"arg_min({_txt(k)}, rn) AS {c}" for c, k in e.frozen.items()]
    cols += [f"arg_max({_opt(k)}, rn) FILTER (WHERE {_opt(k)} IS NOT NULL) AS {c}" for c, k in e.numbers.items()]
    cols += [f"arg_max(trunc({_opt(k)})::BIGINT, rn) FILTER (WHERE {_opt(k)} IS NOT NULL) AS {c}" for c, k in e.counts.items()]
    cols += [f"max(trunc({_num(k)}))::BIGINT AS {c}" if kind == "bigint" else f"max({_num(k)}) AS {c}" for c, (k, kind) in e.tops.items()]
    if e.attempts:
        cols.append(f"max(CASE WHEN trunc({_num('attempt')})>0 THEN trunc({_num('attempt')})::INT ELSE 1 END)::INT AS attempt")
    return f"""SELECT instance_id, {id_sql} AS {e.key}, {', '.join(cols)}, coalesce(arg_max(CASE state WHEN 'failed' THEN 'failed' ELSE 'completed' END, rn) FILTER (WHERE state<>'started'),'active') AS status,
  arg_min(occurred_at, rn) FILTER (WHERE state='started') AS started_at, arg_max(occurred_at, rn) FILTER (WHERE state<>'started') AS ended_at
FROM ev WHERE family='{e.families[0]}' AND state IN ('started','completed','failed') AND {id_sql}<>'' GROUP BY 1,2"""


query("proj_agent_runs", lambda t: reduce.reduce_runs(clean_of(t, "agent")), RAW, _fold(reduce.RUNS, _txt("runId")), (CHECKED, FIRSTS, RANKED))
query("proj_tool_calls", lambda t: reduce.reduce_tools(clean_of(t, "tool")), RAW, _fold(reduce.TOOLS, _txt("toolCallId")), (CHECKED, FIRSTS, RANKED))
query("proj_mcp_calls", lambda t: reduce.reduce_mcp(clean_of(t, "mcp")), RAW, _fold(reduce.MCP, _txt("toolCallId")), (CHECKED, FIRSTS, RANKED))
query("proj_subagent_runs", lambda t: reduce.reduce_subagents(clean_of(t, "subagent")), RAW,
      _fold(reduce.SUBAGENTS, f"coalesce(nullif({_txt('subagentId')},''), {_txt('runId')})"), (CHECKED, FIRSTS, RANKED))

HISTORY = f"""upd AS (SELECT instance_id, event_id, rn, {_txt('runId')} AS run_id, {_txt('provider')} AS provider, {_txt('model')} AS model,
   trunc({_num('inputTokens')})::BIGINT AS input_tokens, trunc({_num('outputTokens')})::BIGINT AS output_tokens, trunc({_num('cacheReadTokens')})::BIGINT AS cache_read_tokens,
   trunc({_num('cacheWriteTokens')})::BIGINT AS cache_write_tokens, {_num('costUsd')} AS cost_usd
  FROM ev WHERE family='llm' AND state IN ('started','completed','failed') AND {_txt('callId')}='' AND json_extract(payload,'$.accountingUpdate')='true' AND {_txt('runId')}<>''),
hist AS (SELECT instance_id, {_txt('callId')} AS call_id, rn, lead(rn) OVER w AS until_rn,
   last_value(nullif({_txt('runId')},'') IGNORE NULLS) OVER w AS run_id, coalesce(last_value(nullif({_txt('provider')},'') IGNORE NULLS) OVER w,'') AS provider, coalesce(last_value(nullif({_txt('model')},'') IGNORE NULLS) OVER w,'') AS model,
   coalesce(last_value(CASE WHEN state<>'started' THEN occurred_at END IGNORE NULLS) OVER w, first_value(CASE WHEN state='started' THEN occurred_at END IGNORE NULLS) OVER w) AS newest
  FROM ev WHERE family='llm' AND state IN ('started','completed','failed') AND {_txt('callId')}<>'' WINDOW w AS (PARTITION BY instance_id, {_txt('callId')} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
matched AS (SELECT * FROM (SELECT u.*, h.call_id, row_number() OVER (PARTITION BY u.rn ORDER BY h.newest DESC, h.call_id DESC) AS pick
  FROM upd u JOIN hist h ON h.instance_id=u.instance_id AND h.run_id=u.run_id AND h.rn<u.rn AND (h.until_rn IS NULL OR h.until_rn>u.rn) AND (u.provider='' OR u.provider=h.provider) AND (u.model='' OR u.model=h.model)) WHERE pick=1)"""
HISTORY = HISTORY.replace("lead(rn) OVER w AS until_rn", "lead(rn) OVER (PARTITION BY instance_id, " + _txt('callId') + " ORDER BY rn) AS until_rn")
query("usage_updates", lambda t: reduce.match_usage(clean_of(t, "llm")).withColumn("cost_usd", F.col("cost_usd").cast("double")), RAW, """
SELECT instance_id, event_id, run_id, call_id, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, cost_usd FROM matched
""", (CHECKED, FIRSTS, RANKED, HISTORY))
query("proj_llm_calls", lambda t: reduce.reduce_llm_calls(clean_of(t, "llm")).withColumn("cost_usd", F.col("cost_usd").cast("double")), RAW, f"""
, base AS ({_fold(reduce.LLM, _txt("callId"))}),
up AS (SELECT instance_id, call_id, max(input_tokens) i, max(output_tokens) o, max(cache_read_tokens) r, max(cache_write_tokens) w, max(cost_usd) c FROM matched GROUP BY 1,2)
SELECT base.* REPLACE (greatest(input_tokens, up.i) AS input_tokens, greatest(output_tokens, up.o) AS output_tokens, greatest(cache_read_tokens, up.r) AS cache_read_tokens,
  greatest(cache_write_tokens, up.w) AS cache_write_tokens, greatest(cost_usd, up.c) AS cost_usd) FROM base LEFT JOIN up USING (instance_id, call_id)
""", (CHECKED, FIRSTS, RANKED, HISTORY))

query("proj_sessions", lambda t: reduce.reduce_sessions(clean_of(t, "session")), RAW, f"""
SELECT instance_id, {_txt('sessionId')} AS session_id, coalesce(arg_max({_txt('sessionKeyHash')}, rn) FILTER (WHERE state='started' AND {_txt('sessionKeyHash')}<>''),
    arg_min({_txt('sessionKeyHash')}, rn)) AS session_key_hash, coalesce(arg_max({_txt('agentId')}, rn) FILTER (WHERE {_txt('agentId')}<>''),'') AS agent_id,
  arg_max(CASE state WHEN 'started' THEN 'active' ELSE state END, rn) AS status, arg_min(occurred_at, rn) FILTER (WHERE state='started') AS started_at,
  arg_max(occurred_at, rn) FILTER (WHERE state<>'started') AS ended_at, arg_max({_txt('reason')}, rn) FILTER (WHERE state<>'started') AS end_reason,
  coalesce(arg_max(trunc({_num('messageCount')})::BIGINT, rn) FILTER (WHERE state<>'started'),0) AS message_count
FROM ev WHERE family='session' AND {_txt('sessionId')}<>'' GROUP BY 1,2
""", (CHECKED, FIRSTS, RANKED))
query("proj_retry_events", lambda t: reduce.reduce_retries(clean_of(t, "llm")), RAW, f"""
SELECT event_id, instance_id, {', '.join(f"{_txt(k)} AS {c}" for c, k in {'session_id': 'sessionId', 'run_id': 'runId', 'trace_id': 'traceId', 'span_id': 'spanId', 'parent_span_id': 'parentSpanId', 'from_provider': 'fromProvider', 'from_model': 'fromModel', 'to_provider': 'toProvider', 'to_model': 'toModel', 'reason': 'reason'}.items())},
  CASE WHEN {_num('attempt')}>=1 THEN trunc({_num('attempt')})::INT ELSE 1 END AS attempt, occurred_at FROM led WHERE event_type='llm.retried'
""", (CHECKED, FIRSTS))
query("proj_resource_samples", lambda t: reduce.reduce_samples(t.host_events), ("host_events",), f"""
SELECT event_id, instance_id, process_id, occurred_at AS sampled_at, ({_num('cpuSecondsTotal')})::DOUBLE AS cpu_seconds_total,
  {', '.join(f"trunc({_num(k)})::BIGINT AS {c}" for c, k in {'resident_memory_bytes': 'residentMemoryBytes', 'virtual_memory_bytes': 'virtualMemoryBytes', 'threads': 'threads', 'open_fds': 'openFds', 'read_bytes': 'readBytesTotal', 'write_bytes': 'writeBytesTotal', 'disk_total_bytes': 'diskTotalBytes', 'disk_available_bytes': 'diskAvailableBytes'}.items())}
FROM host_events WHERE event_type='resource.sampled'
""")


def instances_sql(source: str) -> str:
    """CTEs that fold ``source`` into ``instances`` step by step."""
    return f"""gw AS (SELECT *, row_number() OVER o AS rn, last_value(CASE WHEN event_type='gateway.started' THEN occurred_at END IGNORE NULLS) OVER (PARTITION BY instance_id ORDER BY received_at, producer_id, sequence, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur_start,
   max(CASE WHEN event_type IN ('gateway.started','gateway.heartbeat') THEN 1 ELSE 0 END) OVER (PARTITION BY instance_id ORDER BY received_at, producer_id, sequence, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS born
  FROM {source} WHERE event_type LIKE 'gateway.%' OR event_type='resource.sampled' WINDOW o AS (PARTITION BY instance_id ORDER BY received_at, producer_id, sequence, event_id)),
gwe AS (SELECT *, event_type IN ('gateway.started','gateway.heartbeat') OR (event_type IN ('gateway.stopped','gateway.crashed') AND born=1 AND (cur_start IS NULL OR cur_start<=occurred_at)) AS eff FROM gw),
lastrow AS (SELECT instance_id, max(rn) AS rn FROM gwe WHERE eff GROUP BY 1),
instances AS (SELECT g.instance_id,
  coalesce(arg_max(coalesce(json_extract_string(payload,'$.pluginVersion'),''), g.rn) FILTER (WHERE event_type='gateway.started'),'') AS plugin_version,
  coalesce(arg_max(coalesce(json_extract_string(payload,'$.runtimeVersion'),''), g.rn) FILTER (WHERE event_type='gateway.started'),'') AS runtime_version,
  nullif(arg_max(coalesce(process_id,-1), g.rn) FILTER (WHERE event_type='gateway.started' OR (event_type='gateway.heartbeat' AND process_id IS NOT NULL)),-1)::INT AS process_id,
  arg_max(CASE event_type WHEN 'gateway.stopped' THEN 'stopped' WHEN 'gateway.crashed' THEN 'crashed' ELSE 'up' END, g.rn) FILTER (WHERE eff) AS status,
  arg_max(occurred_at, g.rn) FILTER (WHERE event_type='gateway.started') AS started_at,
  greatest(arg_max(occurred_at, g.rn) FILTER (WHERE eff), max(occurred_at) FILTER (WHERE event_type='resource.sampled' AND g.rn>l.rn)) AS last_seen_at,
  nullif(arg_max(CASE event_type WHEN 'gateway.started' THEN TIMESTAMP '1900-01-01' ELSE occurred_at END, g.rn) FILTER (WHERE eff AND event_type<>'gateway.heartbeat'),TIMESTAMP '1900-01-01') AS stopped_at
 FROM gwe g JOIN lastrow l ON l.instance_id=g.instance_id GROUP BY 1)"""


query("proj_instances", lambda t: reduce.reduce_instances(t.host_events), ("host_events",), "SELECT * FROM instances", (instances_sql("host_events"),))

query("backfill_agent", lambda t: _backfilled(t), ("raw_events", "agent_runs", "sessions", "subagent_runs"), f"""
, sn AS (SELECT instance_id, {_txt('sessionId')} AS session_id, nullif(arg_max(trim(json_extract_string(payload,'$.agentId')), (occurred_at, sequence, event_id)),'') AS a FROM led
  WHERE event_type IN ('session.started','session.completed','session.failed') AND json_type(payload,'$.agentId')='VARCHAR' GROUP BY 1,2),
rn AS (SELECT instance_id, {_txt('runId')} AS run_id, nullif(arg_max(trim(json_extract_string(payload,'$.agentId')), (occurred_at, sequence, event_id)),'') AS a FROM led
  WHERE event_type IN ('agent.started','agent.completed','agent.failed') AND json_type(payload,'$.agentId')='VARCHAR' GROUP BY 1,2),
s2 AS (SELECT s.instance_id, s.session_id, coalesce(nullif(s.agent_id,''), sn.a) AS agent_id FROM sessions s LEFT JOIN sn USING (instance_id, session_id))
SELECT 'run' AS kind, r.instance_id, r.run_id AS id, coalesce(nullif(r.agent_id,''), rn.a, s2.agent_id, nullif(sr.agent_id,'')) AS agent_id
FROM agent_runs r LEFT JOIN rn USING (instance_id, run_id) LEFT JOIN s2 ON s2.instance_id=r.instance_id AND s2.session_id=r.session_id
LEFT JOIN subagent_runs sr ON sr.instance_id=r.instance_id AND sr.subagent_id=r.run_id
UNION ALL SELECT 'session', instance_id, session_id, agent_id FROM s2
""", (CHECKED, FIRSTS))


def _backfilled(t):
    sessions, runs = reduce.backfill_agent_id(clean_of(t, "session", "agent"), t.sessions, t.agent_runs, t.subagent_runs)
    return (runs.select(F.lit("run").alias("kind"), "instance_id", F.col("run_id").alias("id"), "agent_id")
            .unionByName(sessions.select(F.lit("session").alias("kind"), "instance_id", F.col("session_id").alias("id"), "agent_id")))


query("crash_streaks", lambda t: reduce.detect_crashes(t.probes), ("probes",), """
, p AS (SELECT *, sum((ok OR missing)::INT) OVER (PARTITION BY instance_id ORDER BY probed_at, probe_id ROWS UNBOUNDED PRECEDING) AS island FROM probes),
f AS (SELECT *, row_number() OVER (PARTITION BY instance_id, island ORDER BY probed_at, probe_id) AS n FROM p WHERE NOT ok AND NOT missing)
SELECT instance_id, probed_at, probe_id, 'sampling_failed' AS reason, 3::BIGINT AS failure_count FROM f WHERE n % 3 = 0
UNION ALL SELECT instance_id, probed_at, probe_id, 'process_missing', NULL FROM probes WHERE NOT ok AND missing
""")
query("reconcile_liveness", lambda t: reduce.reconcile_liveness(t.agent_runs, t.instances).groupBy("instance_id", "status").agg(F.count("*").alias("runs")),
      ("agent_runs", "ledger"), """
SELECT r.instance_id, CASE WHEN r.status='active' AND i.status IN ('stopped','crashed') THEN 'incomplete' ELSE r.status END AS status, count(*) AS runs
FROM agent_runs r LEFT JOIN instances i USING (instance_id) GROUP BY 1,2
""", (instances_sql("ledger"),))
