"""Maps the driver's star-schema tables onto telemetry tables.

Every table is one SQL text in the subset Spark SQL and DuckDB share, so the
same text feeds the Spark queries and the oracle statements.  All expressions
are row-local or equi-joins on unique keys; nothing here orders a whole group.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.once import evaluated
from ..tables import Tables

DRIVER_TABLES = ("nation", "customer", "part", "orders", "lineitem", "events")

NOW_ORDERS = "2001-12-01 00:00:00"
NOW_EVENTS = "2024-01-31 00:00:00"
NOW_INTAKE = "2002-06-01 00:00:00"

SPREAD_BY = {"lineitem": "l_orderkey", "orders": "o_custkey", "owners": "o_orderkey"}
SPREAD_IN = {"raw_lines": ("lineitem",), "owners": ("orders",), "order_events": ("owners",), "hooks": ("owners",)}
SPREAD_BYTES = 4 << 20  # bytes of a stored table that become one task's rows; texts of events are some thirty times larger

# tables with a long computed payload: queries on them should see values, as they would from files
EVALUATED = {"raw_events", "host_events"}

# table name -> (inputs, text)
FIXTURE_SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def _table(name: str, inputs: tuple[str, ...], text: str) -> None:
    FIXTURE_SQL[name] = (inputs, text)


_table("cust", ("customer", "nation"), """
select c_custkey, concat('inst-', cast(n_regionkey as string)) as instance_id, lower(c_mktsegment) as seg
from {customer} join {nation} on c_nationkey = n_nationkey
""")

_table("agent_runs", ("orders", "cust"), """
select instance_id, concat('r-', cast(o_orderkey as string)) as run_id,
  concat('s-', cast(o_custkey as string)) as session_id,
  case when o_orderkey % 5 = 0 then 'batch' when o_orderkey % 5 = 1 then '' end as agent_id,
  concat('prov-', cast(o_orderkey % 4 as string)) as provider,
  case when o_orderkey % 9 = 0 then '' else concat('m-', cast(o_orderkey % 6 as string)) end as model,
  case when o_orderkey % 2 = 0 then 'chat' else 'api' end as channel,
  case when o_orderkey % 3 = 0 then 'cron' else 'user' end as trigger,
  case o_orderstatus when 'F' then 'failed' when 'P' then 'completed' else 'active' end as status,
  case when o_orderstatus = 'F' and o_orderkey % 50 = 0 then null
    else cast(o_orderdate + (o_orderkey % 86400) * interval '1' second as timestamp) end as started_at,
  case when o_orderstatus <> 'O' then cast(o_orderdate + (o_orderkey % 86400 + 60 + o_orderkey % 600) * interval '1' second as timestamp) end as ended_at,
  case when o_orderstatus <> 'O' then cast(floor(o_totalprice) as double) end as duration_ms,
  case when o_orderstatus = 'F' then lower(substr(o_orderpriority, 3)) else '' end as error_category,
  case when o_orderkey % 4 = 0 then '' else concat('t-', cast(o_orderkey as string)) end as trace_id,
  case when o_orderkey % 3 = 0 then '' else concat('r-', cast(o_orderkey as string)) end as span_id,
  '' as parent_span_id
from {orders} join {cust} on o_custkey = c_custkey
""")

_table("sessions", ("orders", "cust"), """
select instance_id, concat('s-', cast(c_custkey as string)) as session_id,
  concat('sha256:', substr(md5(cast(c_custkey as string)), 1, 24)) as session_key_hash,
  case when c_custkey % 7 = 0 then null when c_custkey % 7 = 1 then '' else seg end as agent_id,
  case c_custkey % 3 when 0 then 'active' when 1 then 'completed' else 'failed' end as status,
  cast(lo as timestamp) as started_at,
  case when c_custkey % 3 <> 0 then cast(hi as timestamp) end as ended_at,
  case c_custkey % 3 when 1 then 'done' when 2 then 'unknown' else '' end as end_reason,
  cast(coalesce(n, 0) as bigint) as message_count
from {cust} left join (
  select o_custkey, min(o_orderdate) as lo, max(o_orderdate) as hi, count(*) as n from {orders} group by o_custkey
) o on o.o_custkey = c_custkey
""")

_table("subagent_runs", ("orders", "cust"), """
select instance_id, concat('r-', cast(o_orderkey as string)) as subagent_id,
  concat('r-', cast(first_key as string)) as parent_run_id,
  concat('sha256:', substr(md5(cast(o_orderkey as string)), 1, 24)) as child_session_hash,
  concat('sub-', cast(o_orderkey % 3 as string)) as agent_id,
  case when o_orderkey % 2 = 0 then 'sync' else 'async' end as mode,
  concat('prov-', cast(o_orderkey % 4 as string)) as provider,
  concat('m-', cast(o_orderkey % 6 as string)) as model,
  case o_orderstatus when 'F' then 'failed' when 'P' then 'completed' else 'active' end as status,
  cast(o_orderdate + (o_orderkey % 86400) * interval '1' second as timestamp) as started_at,
  case when o_orderstatus <> 'O' then cast(o_orderdate + (o_orderkey % 86400 + 45) * interval '1' second as timestamp) end as ended_at,
  case when o_orderstatus = 'P' then 'ok' when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 'error' else '' end as outcome,
  '' as trace_id, '' as span_id, '' as parent_span_id
from {orders} join {cust} on o_custkey = c_custkey
  join (select o_custkey as first_cust, min(o_orderkey) as first_key from {orders} group by o_custkey) f on f.first_cust = o_custkey
where o_orderkey % 11 = 0
""")

# one row per line with the shared call columns; prev_call gives some spans a deeper parent
_table("lines", ("lineitem", "orders", "cust"), """
select instance_id, seg, case when l_partkey % 29 = 0 then '' else concat('r-', cast(l_orderkey as string)) end as run_id,
  concat('s-', cast(o_custkey as string)) as session_id,
  concat(cast(l.l_orderkey as string), '-', cast(l.l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as call_id,
  l.l_orderkey, l.l_linenumber, l_partkey, l_suppkey, l_linestatus,
  cast(floor(l_quantity) as bigint) as quantity, l_extendedprice,
  case l_returnflag when 'R' then 'failed' when 'A' then 'completed' else 'active' end as status,
  case when l_partkey % 41 = 0 and l_returnflag <> 'N' then null
    else cast(l_shipdate + (l_partkey % 86400) * interval '1' second as timestamp) end as started_at,
  case when l_returnflag <> 'N' then cast(l_shipdate + (l_partkey % 86400 + l_suppkey % 90) * interval '1' second as timestamp) end as ended_at,
  case when l_returnflag <> 'N' then cast(floor(l_extendedprice) as double) end as duration_ms,
  case when l_returnflag <> 'R' then '' when l_suppkey % 4 = 0 then 'Timeout' when l_suppkey % 4 = 1 then '' else 'rate_limit' end as error_category,
  case when l_partkey % 4 = 0 then '' else concat('t-', cast(l.l_orderkey as string)) end as trace_id,
  case when l_partkey % 4 = 0 then '' else concat(cast(l.l_orderkey as string), '-', cast(l.l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) end as span_id,
  case when l_partkey % 6 in (0, 1) and head is not null then head when l_partkey % 6 = 2 then '' else concat('r-', cast(l.l_orderkey as string)) end as parent_span_id,
  1 + cast(l_suppkey % 3 as int) as attempt,
  case when l_suppkey % 3 = 2 then 'rate_limit' else '' end as retry_reason
from {lineitem} l join {orders} on l.l_orderkey = o_orderkey join {cust} on o_custkey = c_custkey
  left join (
    select l_orderkey as h_orderkey, l_linenumber as h_linenumber,
      max(concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string))) as head
    from {lineitem} group by l_orderkey, l_linenumber
  ) h on h_orderkey = l.l_orderkey and h_linenumber = l.l_linenumber - 1
""")

_table("llm_calls", ("lines", "part"), """
select instance_id, call_id, run_id, session_id,
  concat('prov-', cast(l_suppkey % 4 as string)) as provider,
  case when l_partkey % 17 = 0 then null when l_partkey % 13 = 0 then '' else lower(p_type) end as model,
  status, started_at, ended_at, duration_ms, error_category,
  quantity * 100 as input_tokens, quantity * 10 as output_tokens,
  case when l_linestatus = 'O' then quantity * 50 else 0 end as cache_read_tokens,
  quantity * (l_partkey % 10) as cache_write_tokens,
  case when l_partkey % 5 = 0 then cast(0 as decimal(18,6))
    else cast(cast(l_extendedprice as decimal(18,2)) as decimal(18,6)) end as cost_usd,
  trace_id, span_id, parent_span_id,
  cast(l_partkey % 500 as double) as time_to_first_byte_ms,
  case when l_partkey % 3 <> 0 then cast(l_partkey % 500 + 50 as double) end as time_to_first_token_ms,
  cast(floor(duration_ms / 2) as double) as generation_duration_ms,
  case when status = 'completed' then 'stop' else '' end as stop_reason,
  attempt, retry_reason,
  l_partkey * 10 as request_bytes, case when status <> 'active' then l_partkey * 20 end as response_bytes
from {lines} left join {part} on l_partkey = p_partkey
where l_linenumber <= 4
""")

_table("tool_calls", ("lines",), """
select instance_id, call_id as tool_call_id, run_id, session_id,
  case when l_partkey % 19 = 0 then null else concat('tool-', cast(l_suppkey % 12 as string)) end as tool_name,
  'builtin' as tool_source, seg as tool_owner,
  status, started_at, ended_at, duration_ms, error_category, trace_id, span_id, parent_span_id, attempt, retry_reason
from {lines} where l_linenumber in (5, 6)
""")

_table("mcp_calls", ("lines",), """
select instance_id, call_id, run_id, session_id,
  concat('mcp-', cast(l_suppkey % 5 as string)) as tool_name, seg as owner,
  status, started_at, ended_at, duration_ms, error_category, trace_id, span_id, parent_span_id, attempt, retry_reason
from {lines} where l_linenumber = 7
""")

_table("retry_events", ("lines",), """
select md5(concat('retry', call_id)) as event_id, instance_id, session_id, run_id, trace_id,
  '' as span_id, '' as parent_span_id,
  concat('prov-', cast(l_suppkey % 4 as string)) as from_provider, concat('m-', cast(l_partkey % 6 as string)) as from_model,
  concat('prov-', cast((l_suppkey + 1) % 4 as string)) as to_provider,
  case when l_partkey % 7 = 0 then '' else concat('m-', cast((l_partkey + 1) % 6 as string)) end as to_model,
  attempt, retry_reason as reason, coalesce(ended_at, started_at) as occurred_at
from {lines} where l_linenumber <= 4 and attempt > 1
""")

_table("resource_samples", ("events",), """
select md5(concat('sample', cast(event_id as string))) as event_id, concat('inst-', cast(user_id % 5 as string)) as instance_id,
  cast(1000 + user_id % 2 as int) as process_id, cast(ts as timestamp) as sampled_at,
  cast(event_id * 10 + floor(value) as double) as cpu_seconds_total,
  1000000 + (event_id % 1000) * 1024 as resident_memory_bytes, 2000000 + (event_id % 1000) * 2048 as virtual_memory_bytes,
  cast(4 + event_id % 3 as int) as threads, cast(20 + event_id % 11 as int) as open_fds,
  event_id * 512 as read_bytes, event_id * 256 as write_bytes,
  case when event_id % 50 = 0 then 0 else 10000000000 end as disk_total_bytes,
  case when event_id % 50 = 0 then 0 else 10000000000 - event_id * 1000 end as disk_available_bytes
from {events}
""")

_table("ledger", ("events",), """
select md5(cast(event_id as string)) as event_id, 1 as schema_version,
  case event_type when 'click' then 'gateway.heartbeat' when 'signup' then 'gateway.started'
    when 'purchase' then case when event_id % 5 = 0 then 'gateway.crashed' else 'gateway.stopped' end
    when 'error' then case when event_id % 4 = 0 then 'monitor.plugin_error' else 'monitor.events_dropped' end
    else 'resource.sampled' end as event_type,
  cast(ts as timestamp) as occurred_at,
  concat('inst-', cast(user_id % 5 as string)) as instance_id, concat('prod-', cast(user_id % 5 as string)) as producer_id,
  case when event_id % 9 = 0 then null else cast(1000 + user_id % 2 as int) end as process_id,
  event_id as sequence, 'plugin' as source,
  case event_type
    when 'click' then concat('{{"queueDepth":', cast(event_id % 100 as string), ',"queueCapacity":100}}')
    when 'signup' then concat('{{"pluginVersion":"1.', cast(event_id % 10 as string), '","runtimeVersion":"2.', cast(event_id % 7 as string), '"}}')
    when 'error' then case when event_id % 3 = 0 then '{{}}' else concat('{{"reason":"r', cast(event_id % 3 as string), '","count":', cast(event_id % 6 as string), '}}') end
    else props end as payload,
  cast(ts + (event_id % 997) * interval '1' second as timestamp) as received_at
from {events}
""")

# intake with several, late, repeated and malformed events per entity
_table("raw_lines", ("lineitem", "orders", "cust"), """
select l.*, o_custkey, instance_id, seg,
  case when l_linenumber <= 4 then 'llm' when l_linenumber <= 6 then 'tool' else 'mcp' end as family,
  case l_returnflag when 'N' then 'started' when 'A' then 'completed' else 'failed' end as state,
  concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as entity_id,
  md5(concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string))) as line_id,
  l_partkey % 970 as dirt,
  cast(timestamp '2002-01-01 00:00:00' + (l_partkey * 7 + l_suppkey) * interval '1' second as timestamp) as arrived_at,
  cast(l_shipdate + (l_partkey % 86400) * interval '1' second as timestamp) as happened_at
from {lineitem} l join {orders} on l_orderkey = o_orderkey join {cust} on o_custkey = c_custkey
""")

_table("call_events", ("raw_lines",), """
select case when dirt = 0 then 2 else 1 end as schema_version,
  case when dirt = 1 then 'short-id' else line_id end as event_id,
  case when dirt = 2 then 'made.up' else concat(family, '.', state) end as event_type,
  case when dirt = 3 then timestamp '2030-01-01 00:00:00' else happened_at end as occurred_at,
  case when dirt = 4 then 'bad id!' else instance_id end as instance_id,
  concat('prod-', cast(l_suppkey % 8 as string)) as producer_id,
  case when dirt = 6 then 0 when l_partkey % 3 = 0 then null else cast(1000 + l_suppkey as int) end as process_id,
  l_orderkey * 8 + l_linenumber as sequence,
  case when dirt = 5 then 'other' when l_partkey % 2 = 0 then 'plugin' else 'daemon' end as source,
  case when dirt = 7 then '[1]' when dirt = 8 then 'not json' when dirt = 9 then concat('{{"x":"', repeat('x', 20000), '"}}')
    when l_partkey % 23 = 0 and family = 'llm' then concat('{{"accountingUpdate":true,"runId":"r-', cast(l_orderkey as string),
      case when l_suppkey % 2 = 0 then concat('","provider":"prov-', cast(l_linenumber % 2 as string)) else '' end,
      '","inputTokens":', cast(cast(floor(l_quantity) as bigint) * 7 as string), ',"cacheReadTokens":', cast(l_partkey % 100 as string), ',"costUsd":', cast(cast(l_extendedprice as decimal(18,2)) as string), '}}')
    when family = 'llm' then concat('{{"callId":"', case when l_partkey % 61 = 0 then '' else entity_id end, '","runId":"r-', cast(l_orderkey as string), '","sessionId":"s-', cast(o_custkey as string),
      '","provider":"', case when l_partkey % 4 = 3 then '' else concat('prov-', cast(l_linenumber % 2 as string)) end, '","model":', case when l_partkey % 31 = 0 then '5' else concat('"m-', cast(l_partkey % 6 as string), '"') end,
      case when state = 'started' then '' else concat(',"durationMs":', cast(cast(floor(l_extendedprice) as bigint) as string)) end,
      case when l_partkey % 7 = 0 and state = 'started' then ',"durationMs":"slow"' else '' end,
      ',"inputTokens":', cast(cast(floor(l_quantity) as bigint) * 100 as string), ',"outputTokens":', cast(cast(floor(l_quantity) as bigint) as string),
      ',"costUsd":', cast(cast(l_extendedprice as decimal(18,2)) as string),
      case when state = 'failed' then ',"errorCategory":"rate_limit"' else '' end,
      ',"attempt":', cast(l_suppkey % 3 as string), ',"timeToFirstByteMs":', cast(l_partkey % 500 as string), ',"requestPayloadBytes":', cast(l_partkey as string), '}}')
    else concat('{{"toolCallId":"', entity_id, '","runId":"r-', cast(l_orderkey as string), '","toolName":"', family, '-', cast(l_suppkey % 5 as string), '","toolOwner":"', seg, '","toolSource":"', family,
      '","attempt":', cast(l_suppkey % 3 as string), case when state = 'started' then '' else concat(',"durationMs":', cast(cast(floor(l_extendedprice) as bigint) as string)) end,
      case when state = 'failed' then ',"errorCategory":"timeout"' else '' end, '}}') end as payload,
  arrived_at as received_at, concat('b-', cast(cast(floor(l_orderkey / 8) as bigint) as string)) as batch_id
from {raw_lines}
""")

_table("order_events", ("orders", "cust"), """
select 1 as schema_version, md5(concat('o', cast(k as string), cast(o_orderkey as string))) as event_id,
  case k when 0 then 'agent.started' when 1 then case o_orderstatus when 'F' then 'agent.failed' else 'agent.completed' end
    when 2 then 'session.started' when 3 then case when o_custkey % 2 = 0 then 'session.completed' else 'session.failed' end
    when 4 then 'subagent.started' when 5 then case o_orderstatus when 'F' then 'subagent.failed' else 'subagent.completed' end
    else 'llm.retried' end as event_type,
  cast(o_orderdate + (o_orderkey % 86400 + k * 30) * interval '1' second as timestamp) as occurred_at,
  instance_id, concat('prod-', cast(o_orderkey % 8 as string)) as producer_id,
  cast(2000 + o_orderkey % 5 as int) as process_id, o_orderkey * 8 + 100000000 + k as sequence, 'plugin' as source,
  case when k <= 1 then concat('{{"runId":"r-', cast(o_orderkey as string), '","sessionId":"s-', cast(o_custkey as string), '","agentId":"', case when o_orderkey % 3 = 0 then '' else seg end, '"',
      case when k = 0 then concat(',"provider":"prov-', cast(o_orderkey % 4 as string), '","trigger":"user"') else concat(',"durationMs":', cast(cast(floor(o_totalprice) as bigint) as string), ',"model":"m-', cast(o_orderkey % 6 as string), '"') end,
      case when k = 1 and o_orderstatus = 'F' then concat(',"errorCategory":"', lower(substr(o_orderpriority, 3)), '"') else '' end, '}}')
    when k <= 3 then concat('{{"sessionId":"s-', cast(o_custkey as string), '","agentId":"', case when o_orderkey % 4 = 0 then '' else seg end, '","sessionKeyHash":"', case when o_orderkey % 5 = 0 then '' else substr(md5(cast(o_orderkey as string)), 1, 24) end, '"',
      case when k = 3 then concat(',"reason":"end","messageCount":', cast(o_orderkey % 40 as string)) else '' end, '}}')
    when k <= 5 then concat('{{"runId":"r-', cast(o_orderkey as string), '","parentRunId":"r-', cast(o_orderkey + 1 as string), '","agentId":"sub-', cast((o_orderkey + k) % 3 as string), '","mode":"m', cast(k as string), '","outcome":"', case when k = 5 then 'ok' else '' end, '"}}')
    else concat('{{"runId":"r-', cast(o_orderkey as string), '","fromProvider":"prov-0","toProvider":"prov-1","toModel":"m-', cast(o_orderkey % 6 as string), '","attempt":', cast(o_orderkey % 4 as string), ',"reason":"overload"}}') end as payload,
  cast(timestamp '2002-01-01 00:00:00' + (o_orderkey * 3 + case when o_orderkey % 3 = 0 then 10 - k else k end) * interval '1' second as timestamp) as received_at,
  concat('b-', cast(cast(floor(o_orderkey / 8) as bigint) as string)) as batch_id
from (select *, @fan(7) as k from {orders}) ord join {cust} on o_custkey = c_custkey
where k = 0 or (k = 1 and o_orderstatus <> 'O') or (k = 2 and o_orderkey % 2 = 0) or (k = 3 and o_orderkey % 5 = 0)
  or (k = 4 and o_orderkey % 11 = 0) or (k = 5 and o_orderkey % 11 = 0 and o_orderstatus <> 'O') or (k = 6 and o_orderkey % 13 = 0)
""")

_table("host_events", ("ledger",), """
select schema_version, event_id, event_type, occurred_at, instance_id, producer_id, process_id, sequence, source,
  case when event_type = 'resource.sampled' then concat('{{"cpuSecondsTotal":', cast(sequence as string), ',"residentMemoryBytes":', cast(sequence * 1024 as string), ',"threads":"many"}}') else payload end as payload,
  received_at, concat('h-', cast(cast(floor(sequence / 16) as bigint) as string)) as batch_id
from {ledger}
""")

_ENVELOPE = ("schema_version, event_id, event_type, occurred_at, instance_id, producer_id, process_id, "
             "sequence, source, payload, received_at, batch_id")

_table("raw_events", ("call_events", "order_events"), f"""
select {_ENVELOPE} from {{call_events}}
union all
select schema_version, event_id, event_type, occurred_at, instance_id, producer_id, process_id, sequence, source, payload,
  cast(received_at + interval '1' day as timestamp) as received_at, concat('again-', batch_id) as batch_id
from {{call_events}} where sequence % 10 = 0
union all
select {_ENVELOPE} from {{order_events}}
""")

# runtime diagnostics before they become envelopes
_table("diagnostics", ("raw_lines",), """
select case when l_linenumber = 1 then case state when 'started' then 'run.started' else 'run.completed' end
    when l_linenumber in (2, 3) then case state when 'started' then 'model.call.started' when 'completed' then 'model.call.completed' else 'model.call.error' end
    when l_linenumber = 4 then case when l_suppkey % 5 = 0 then 'model.failover' else 'model.usage' end
    when l_linenumber in (5, 6) then case state when 'started' then 'tool.execution.started' when 'completed' then 'tool.execution.completed' else case when l_suppkey % 2 = 0 then 'tool.execution.error' else 'tool.execution.blocked' end end
    else case l_suppkey % 3 when 0 then 'diagnostic.heartbeat' when 1 then 'diagnostic.async_queue.dropped' else 'session.idle' end end as type,
  happened_at as ts, l_orderkey * 8 + l_linenumber as seq, line_id,
  case when l_partkey % 5 <> 0 then concat('r-', cast(l_orderkey as string)) end as run_id,
  case when l_partkey % 3 <> 0 then concat('s-', cast(o_custkey as string)) end as session_id,
  case when l_partkey % 7 <> 0 then concat(case when l_partkey % 2 = 0 then 'agent:' else 'AGENT:' end, seg, ':', cast(o_custkey as string)) end as session_key,
  cast(null as string) as agent_id,
  case when l_linenumber in (2, 3) then entity_id end as call_id,
  case when l_linenumber in (5, 6) and l_partkey % 4 <> 0 then entity_id end as tool_call_id,
  case when l_partkey % 6 = 0 then null else concat('tool', chr(10), cast(l_suppkey % 5 as string)) end as tool_name,
  case when l_suppkey % 4 = 0 then 'mcp' else 'builtin' end as tool_source, seg as tool_owner,
  case when l_partkey % 4 = 0 then null else concat('prov-', cast(l_suppkey % 4 as string)) end as provider,
  concat('m-', cast(l_partkey % 6 as string)) as model, 'chat' as channel, 'user' as trigger,
  case state when 'completed' then 'completed' else 'error' end as outcome,
  case when state = 'failed' and l_partkey % 2 = 0 then 'timeout' end as error_category,
  case when state <> 'started' then cast(floor(l_extendedprice) as double) end as duration_ms,
  cast(floor(l_quantity) as bigint) as usage_input, cast(l_suppkey as bigint) as usage_output,
  cast(l_partkey % 9 as bigint) as usage_cache_read, cast(0 as bigint) as usage_cache_write,
  cast(cast(l_extendedprice as decimal(18,2)) as double) as cost_usd,
  case when l_partkey % 2 = 0 then cast(l_suppkey % 3 as int) end as attempt,
  cast(l_partkey % 50 as int) as queue_depth, 100 as queue_capacity, cast(l_partkey % 11 as bigint) as dropped,
  concat('prompt of ', cast(o_custkey as string)) as prompt
from {raw_lines}
""")

_table("hooks", ("orders", "cust"), """
select case k when 0 then 'session_start' when 1 then 'session_end' when 2 then 'subagent_spawned' else 'subagent_ended' end as hook,
  cast(o_orderdate + (o_orderkey % 86400 + k * 30) * interval '1' second as timestamp) as ts, o_orderkey * 4 + k as seq,
  instance_id, concat('s-', cast(o_custkey as string)) as session_id,
  case when k < 2 then concat('agent:', seg, ':', cast(o_custkey as string)) end as session_key,
  case when k >= 2 then concat('agent:', seg, ':child:', cast(o_orderkey as string)) end as child_session_key,
  case when k = 2 and o_orderkey % 3 = 0 then null when k = 3 and o_orderkey % 2 = 0 then null when k >= 2 then concat('r-', cast(o_orderkey as string)) end as run_id,
  case when k = 2 then concat('r-', cast(o_orderkey + 1 as string)) end as parent_run_id,
  seg as agent_id, case when k = 2 then 'sync' end as mode,
  case when k = 1 then case when o_orderkey % 6 = 0 then 'unknown' else 'idle' end end as reason,
  case when k = 1 then cast(o_orderkey % 40 as bigint) end as message_count,
  case when k = 3 then case when o_orderkey % 4 = 0 then 'error' when o_orderkey % 5 = 0 then null else 'ok' end end as outcome
from (select *, @fan(4) as k from {orders}) ord join {cust} on o_custkey = c_custkey
where o_orderkey % 2 = 0 or k < 2
""")

_table("probes", ("events",), """
select concat('inst-', cast(user_id % 5 as string)) as instance_id, cast(ts as timestamp) as probed_at, event_id as probe_id,
  event_type in ('click', 'view') as ok, event_id % 97 = 0 as missing
from {events}
""")

_table("metric_samples", ("events",), """
select cast(ts as timestamp) as ts,
  case event_type when 'click' then 'llm_requests_total' when 'signup' then 'llm_requests_total' when 'error' then 'tool_errors_total' when 'purchase' then 'events_dropped_total' else 'resident_memory_bytes' end as metric,
  concat('inst-', cast(user_id % 5 as string)) as instance,
  case event_type when 'click' then 'completed' when 'signup' then 'failed' else '' end as status,
  case when event_type = 'view' then cast(1000000000 + floor(event_id / 200) % 3 * 1000000000 as double) else cast(event_id % 700 as double) end as value
from {events}
""")

# the probe of a gateway, for the hold rules: long stretches of down
_table("up_samples", ("events",), """
select cast(ts as timestamp) as ts, 'gateway_up' as metric, concat('inst-', cast(user_id % 5 as string)) as instance, '' as status,
  case when floor(event_id / 60) % 4 = 0 then 0.0e0 else 1.0e0 end as value
from {events}
""")

_table("price_file", (), """
select 'prov-0/economy' as id, '0.00000032' as prompt, '0.00000128' as completion
union all select 'prov-0/Standard', '0.00000035', '0.0000011'
union all select 'Prov-1/promo', '0.0000012', '0.000004'
union all select 'prov-1/small', '0.0000006', '0.00000192'
union all select 'prov-2/large', '0.00000011', 'n/a'
union all select 'prov-2/medium', '0', '0'
union all select 'prov-2/economy/x', '0.000001', '0.000002'
union all select 'nolash', '0.000001', '0.000002'
union all select 'QWEN/qwen3-max', '0.000002', '0.000003'
union all select 'openai/gpt-4o', '0.0000025', '0.00001'
""")

# --- how Spark builds some of these tables: the same rows with narrower joins ----------
#
# An order meets its customer before it meets lines, so no line is shuffled by customer; the head of the line before comes
# from a window over the order, which the join by order shares; a line meets its part before its columns are made.  Events
# that arrive again are copied from the rows made, so the joins beneath run once.  Orders meet customers by a merge: by the size
# of their compressed files orders would be sent to every task, and all of them would leave the one task that reads customers.

SPARK_SQL: dict[str, tuple[tuple[str, ...], str]] = {"owners": (("orders", "cust"), "select /*+ merge(ord) */ * from {orders} ord join {cust} on o_custkey = c_custkey")}


def _instead(name: str, inputs: tuple[str, ...], *changes: tuple[str, str], of: str | None = None) -> None:
    text = FIXTURE_SQL[of or name][1]
    for old, new in changes:
        if old not in text:
            raise ValueError(f"{name}: {old}")
        text = text.replace(old, new)
    SPARK_SQL[name] = (inputs, text)


_OWNED = ("join {orders} on l_orderkey = o_orderkey join {cust} on o_custkey = c_custkey", "join {owners} on l_orderkey = o_orderkey")
_instead("raw_lines", ("lineitem", "owners"), _OWNED)
for _name, _fan in (("order_events", "@fan(7)"), ("hooks", "@fan(4)")):
    _instead(_name, ("owners",), (f"(select *, {_fan} as k from {{orders}}) ord join {{cust}} on o_custkey = c_custkey", f"(select *, {_fan} as k from {{owners}}) ord"))

_ID = "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string))"
_HEADED = f"(select *, max({_ID}) over (partition by l_orderkey order by l_linenumber range between 1 preceding and 1 preceding) as head from @source where @lines) l join {{owners}} on l.l_orderkey = o_orderkey"
_FROM = FIXTURE_SQL["lines"][1][FIXTURE_SQL["lines"][1].index("from {lineitem} l join"):]
# grouped, so that the optimizer knows a line meets one part at most and leaves the join out where no type is asked for
_TYPED = "(select l.*, p_type from {lineitem} l left join (select p_partkey, max(p_type) as p_type from {part} group by p_partkey) on l_partkey = p_partkey)"
# of the lines a table shows and those before them, which give heads
for _name, _source, _lines, _more in (("lines", "{lineitem}", "true", ""), ("llm_lines", _TYPED, "l_linenumber <= 4", ", p_type"), ("retry_lines", "{lineitem}", "l_linenumber <= 4", ""),
                                      ("tool_lines", "{lineitem}", "l_linenumber between 4 and 6", ""), ("mcp_lines", "{lineitem}", "l_linenumber between 6 and 7", "")):
    _instead(_name, ("lineitem", "owners", "part") if _more else ("lineitem", "owners"),
             (_FROM, "from " + _HEADED.replace("@source", _source).replace("@lines", _lines) + "\n"),
             ("as retry_reason\n", f"as retry_reason{_more}\n"), of="lines")
_instead("llm_calls", ("llm_lines",), ("{lines} left join {part} on l_partkey = p_partkey", "{llm_lines}"))
for _name, _kind in (("tool_calls", "tool"), ("mcp_calls", "mcp"), ("retry_events", "retry")):
    _instead(_name, (f"{_kind}_lines",), ("{lines}", f"{{{_kind}_lines}}"))

_AGAIN = FIXTURE_SQL["raw_events"][1].split("union all")
SPARK_SQL["raw_events"] = (("call_events", "order_events"), f"""
select schema_version, event_id, event_type, occurred_at, instance_id, producer_id, process_id, sequence, source, payload,
  cast(received_at + again * interval '1' day as timestamp) as received_at, case when again = 1 then concat('again-', batch_id) else batch_id end as batch_id
from (select *, explode(case when sequence % 10 = 0 then array(0, 1) else array(0) end) as again from {{call_events}})
union all{_AGAIN[2]}""")


def _order(names, seen=None, out=None):
    seen = set() if seen is None else seen
    out = [] if out is None else out
    for name in names:
        if name in FIXTURE_SQL and name not in seen:
            seen.add(name)
            _order(FIXTURE_SQL[name][0], seen, out)
            out.append(name)
    return out


def _spark_text(text: str) -> str:
    return re.sub(r"@fan\((\d+)\)", lambda m: f"explode(sequence(0, {int(m[1]) - 1}))", text)


def _duckdb_text(text: str) -> str:
    return re.sub(r"@fan\((\d+)\)", lambda m: f"unnest(range(0, {m[1]}))", text)


def duckdb_ctes(*names: str) -> str:
    """The text ``name AS (...), ...`` for the given tables and all they need."""
    parts = []
    for name in _order(names):
        inputs, text = FIXTURE_SQL[name]
        parts.append(f"{name} AS ({_duckdb_text(text).format(**{i: i for i in inputs}).strip()})")
    return ",\n".join(parts)


class FixtureTables(Tables):
    """Telemetry tables over the driver's parquet; attributes are DataFrames built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.sf_dir = sf_dir

    def width(self, table: str) -> int:
        """Tasks for the wide rows made from a driver's table, by the bytes of its files in whatever store they lie."""
        path, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        stored = sum(where.getFileSystem(conf).getFileStatus(where).getLen() for where in map(path, self.get("raw:" + table).inputFiles()))
        return max(self.spark.sparkContext.defaultParallelism, stored // SPREAD_BYTES)

    def _load(self, name: str) -> DataFrame:
        if name == "instances":
            from ..operators.reduce import reduce_instances
            return reduce_instances(self.get("ledger"))
        if name.startswith("raw:"):
            return self.spark.read.parquet(f"{self.sf_dir}/{name[4:]}.parquet")
        if name.startswith("wide:"):
            df, width = self.get("raw:" + name[5:] if name[5:] in DRIVER_TABLES else name[5:]), self.width("lineitem" if name[5:] == "lineitem" else "orders")
            # Few files would make few tasks of wide rows.  Many files do not make many tasks either: scans pack them, and a join
            # of them has as many tasks as cores.  Tasks grow in number with the stored bytes, in whatever files these lie.
            return df.repartition(width, SPREAD_BY[name[5:]])
        inputs, text = SPARK_SQL.get(name) or FIXTURE_SQL[name]
        text = _spark_text(text)
        wide = SPREAD_IN.get(name, ())
        frames = {i: self.get("wide:" + i if i in wide else "raw:" + i if i in DRIVER_TABLES else i) for i in inputs}
        df = self.spark.sql(text, **frames) if frames else self.spark.sql(text.format())
        return evaluated(df, *[F.col(c) for c in df.columns]) if name in EVALUATED else df
