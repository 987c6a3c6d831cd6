"""Lists, details and the status page."""

from __future__ import annotations

from functools import reduce as _fold
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.once import evaluated
from ..tables import Tables
from .attribution import RUN_KEY, run_agents, tool_events, with_agent
from .filters import Filters, blank_to, narrowed, newest
from .reduce import payload_number
from .stats import ALL_TOKENS, count

COUNTED = ("events", "sessions", "agent_runs", "subagent_runs", "llm_calls", "tool_calls", "mcp_calls", "retry_events", "resource_samples")
SESSION_KEY = ["instance_id", "session_id"]


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def named(*columns: str) -> list[Column]:
    return [F.col(c).alias(camel(c)) for c in columns]


def list_instances(t: Tables) -> DataFrame:
    return (t.instances.select(*named("instance_id", "plugin_version", "runtime_version", "process_id", "status", "started_at", "last_seen_at", "stopped_at"))
            .orderBy(F.desc("lastSeenAt"), "instanceId"))


def active_processes(t: Tables) -> DataFrame:
    return t.instances.where("status = 'up' and process_id is not null").select(*named("instance_id", "process_id"))


SESSION_TOTALS = ["llmCalls", "toolCalls", "totalTokens", "costUsd", "errors", "retries"]


def _call_totals(t: Tables, sessions: DataFrame | None = None) -> DataFrame:
    """Calls, tokens, cost, errors and retries per session; each child is summed before the join.

    With a page of sessions given, only their children are read on.
    """
    def of(df: DataFrame) -> DataFrame:
        return df if sessions is None else df.join(sessions.select(*SESSION_KEY), SESSION_KEY, "left_semi")

    zero = F.lit(0).cast("bigint")
    llm = of(t.llm_calls).groupBy(*SESSION_KEY).agg(F.count("*").alias("llmCalls"), F.sum(F.expr(ALL_TOKENS)).alias("totalTokens"),
                                                    F.sum("cost_usd").alias("cost"), count("status = 'failed'").alias("errors"))
    tools = of(tool_events(t)).groupBy(*SESSION_KEY).agg(F.count("*").alias("toolCalls"), count("status = 'failed'").alias("errors"))
    retries = of(t.retry_events).groupBy(*SESSION_KEY).agg(F.count("*").alias("retries"))
    parts = _fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), [llm, tools, retries])
    return parts.groupBy(*SESSION_KEY).agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("llmCalls", "toolCalls", "totalTokens")],
        F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("costUsd"), *[F.coalesce(F.sum(c), zero).alias(c) for c in ("errors", "retries")])


def _with_totals(sessions: DataFrame, t: Tables, page: bool) -> DataFrame:
    df = sessions.join(_call_totals(t, sessions if page else None), SESSION_KEY, "left")
    return df.fillna(0, SESSION_TOTALS)


SESSION_COLUMNS = ["instance_id", "session_id", "session_key_hash", "agent_id", "status", "started_at", "ended_at", "end_reason", "message_count"]


def sessions_page(t: Tables, p: Filters, extra: int = 0) -> DataFrame:
    df = narrowed(t.sessions, p)
    if p.agent:
        df = df.where(blank_to("agent_id") == p.agent)
    df = df.withColumn("instanceId", F.col("instance_id")).withColumn("_at", F.coalesce("started_at", "ended_at"))
    return newest(df, "_at", "session_id", p, extra)


def list_sessions(t: Tables, p: Filters = Filters(), extra: int = 1) -> DataFrame:
    """The newest sessions with their totals; ``extra`` rows past the limit show that more follow.

    The page is cut first, so only the children of its sessions are summed.
    """
    page = sessions_page(t, p, extra)
    out = _with_totals(page, t, True).orderBy(F.desc("_at"), F.desc("session_id"), F.desc("instance_id"))
    return out.select(*named(*SESSION_COLUMNS), *SESSION_TOTALS)


def session_totals(t: Tables, session: tuple[str, str] | None = None) -> DataFrame:
    df = t.sessions.select(*SESSION_KEY)
    if session:
        df = df.where((F.col("instance_id") == session[0]) & (F.col("session_id") == session[1]))
    return _with_totals(df, t, bool(session)).select(*named(*SESSION_KEY), *SESSION_TOTALS)


def list_runs(t: Tables, p: Filters = Filters(), extra: int = 1) -> DataFrame:
    if p.agent:
        df = run_agents(t, p)
    else:
        df = narrowed(t.agent_runs, p)
    df = df.withColumn("_at", F.coalesce("started_at", "ended_at")).withColumn("instanceId", F.col("instance_id"))
    page = newest(df, "_at", "run_id", p, extra)
    if not p.agent:
        page = page.drop("agent_id").join(run_agents(_only(t, page)).select(*RUN_KEY, "agent_id"), RUN_KEY, "left")
    return (page.orderBy(F.desc("_at"), F.desc("run_id"), F.desc("instance_id"))
            .select(*named("instance_id", "run_id", "session_id", "agent_id", "provider", "model", "channel", "trigger", "status",
                           "started_at", "ended_at", "duration_ms", "error_category")))


def _only(t: Tables, page: DataFrame) -> Tables:
    """The same tables with the runs cut to a page."""
    frames = {name: t.get(name) for name in ("sessions", "subagent_runs")}
    frames["agent_runs"] = page.drop("_at", "instanceId")
    return Tables(t.spark, frames)


def _calls_page(calls: DataFrame, t: Tables, p: Filters, key: str) -> DataFrame:
    """Newest calls with their agent; the page is cut before the join unless the agent decides who is on it."""
    df = narrowed(calls, p).withColumn("_at", F.coalesce("started_at", "ended_at")).withColumn("instanceId", F.col("instance_id"))
    if p.agent:
        return newest(with_agent(df, t, p), "_at", key, p)
    page = newest(df, "_at", key, p)
    runs = t.agent_runs.join(page.select(*RUN_KEY).distinct(), RUN_KEY, "left_semi")
    page = with_agent(page, Tables(t.spark, {"agent_runs": runs, "sessions": t.sessions, "subagent_runs": t.subagent_runs}), p)
    return page.orderBy(F.desc("_at"), F.desc(key), F.desc("instance_id"))


def list_llm_calls(t: Tables, p: Filters = Filters()) -> DataFrame:
    df = _calls_page(t.llm_calls, t, p, "call_id").withColumn("total_tokens", F.expr(ALL_TOKENS)).withColumn("cost_usd", F.col("cost_usd").cast("double"))
    return df.select(*named("instance_id", "call_id", "run_id", "session_id", "agent_id", "provider", "model", "status", "started_at", "ended_at", "duration_ms",
                            "error_category", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens", "cost_usd"))


def list_mcp_calls(t: Tables, p: Filters = Filters()) -> DataFrame:
    return _calls_page(t.mcp_calls, t, p, "call_id").select(*named(
        "instance_id", "call_id", "run_id", "session_id", "agent_id", "tool_name", "owner", "status", "started_at", "ended_at", "duration_ms", "error_category"))


def list_subagents(t: Tables, p: Filters = Filters()) -> DataFrame:
    df = t.subagent_runs.withColumn("agent_id", blank_to("agent_id"))
    df = narrowed(df, p, agent="agent_id").withColumn("_at", F.coalesce("started_at", "ended_at")).withColumn("instanceId", F.col("instance_id"))
    return newest(df, "_at", "subagent_id", p).select(*named(
        "instance_id", "subagent_id", "parent_run_id", "child_session_hash", "agent_id", "mode", "provider", "model", "status", "started_at", "ended_at", "outcome"))


def list_resources(t: Tables, p: Filters = Filters()) -> DataFrame:
    df = newest(narrowed(t.resource_samples, p, "sampled_at", None), "sampled_at", "event_id", p)
    return df.select(*named("event_id", "instance_id", "process_id", "sampled_at", "cpu_seconds_total", "resident_memory_bytes", "virtual_memory_bytes", "threads", "open_fds"),
                     F.col("read_bytes").alias("readBytesTotal"), F.col("write_bytes").alias("writeBytesTotal"), *named("disk_total_bytes", "disk_available_bytes"))


def list_events(t: Tables, p: Filters = Filters(), extra: int = 1, decode: bool = False) -> DataFrame:
    """Newest ledger rows; ``decode`` gives the payload as a variant instead of its text."""
    df = narrowed(t.ledger, p, "occurred_at", None)
    if p.event_type:
        df = df.where(F.col("event_type") == p.event_type)
    df = newest(df, "occurred_at", "event_id", p, extra)
    return df.select(*named("event_id", "schema_version", "event_type", "occurred_at", "instance_id", "producer_id", "process_id", "sequence", "source"),
                     (F.try_parse_json("payload") if decode else F.col("payload")).alias("payload"))


def count_tables(t: Tables) -> DataFrame:
    parts = [(t.ledger if name == "events" else t.get(name)).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name in COUNTED]
    return _fold(DataFrame.unionByName, parts)


def count_table(t: Tables, name: str) -> DataFrame:
    if name not in COUNTED:
        raise ValueError("invalid table")
    return (t.ledger if name == "events" else t.get(name)).agg(F.count("*").alias("rows"))


def queue_depths(t: Tables) -> DataFrame:
    """Queue depth on the latest heartbeat of each instance."""
    beats = t.ledger.where("event_type = 'gateway.heartbeat'")
    last = beats.groupBy("instance_id").agg(F.max_by("payload", F.struct("received_at", "producer_id", "sequence", "event_id")).alias("payload"))
    return last.select("instance_id", payload_number("queueDepth").alias("queue_depth"))


def status_summary(t: Tables) -> DataFrame:
    """One row: table counts, active sessions and runs, last arrival, total queue depth."""
    parts = [count_tables(t).select(F.col("name"), F.col("rows").cast("double").alias("value"), F.lit(None).cast("timestamp").alias("at")),
             t.sessions.agg(count("status = 'active'").cast("double").alias("value")).select(F.lit("activeSessions").alias("name"), "value", F.lit(None).cast("timestamp").alias("at")),
             t.agent_runs.agg(count("status = 'active'").cast("double").alias("value")).select(F.lit("activeRuns").alias("name"), "value", F.lit(None).cast("timestamp").alias("at")),
             queue_depths(t).agg(F.coalesce(F.sum("queue_depth"), F.lit(0.0)).alias("value")).select(F.lit("eventQueueDepth").alias("name"), "value", F.lit(None).cast("timestamp").alias("at")),
             t.ledger.agg(F.max("received_at").alias("at")).select(F.lit("lastEventReceivedAt").alias("name"), F.lit(None).cast("double").alias("value"), "at")]
    rows = _fold(DataFrame.unionByName, parts)

    def pick(name: str, column: str = "value") -> Column:
        return F.max(F.when(F.col("name") == name, F.col(column)))

    return rows.agg(*[pick(n).cast("bigint").alias(n) for n in (*COUNTED, "activeSessions", "activeRuns")],
                    pick("eventQueueDepth").alias("eventQueueDepth"), pick("lastEventReceivedAt", "at").alias("lastEventReceivedAt"))


def session_header(t: Tables, session: tuple[str, str]) -> DataFrame:
    return (t.sessions.where((F.col("instance_id") == session[0]) & (F.col("session_id") == session[1])).select(*named(*SESSION_COLUMNS)))


def session_runs(t: Tables, session: tuple[str, str] | None = None, limit: int = 500) -> DataFrame:
    """Runs with trace and span defaults: the newest of one session, or those of every session."""
    mine = t.agent_runs
    if session:
        mine = mine.where((F.col("instance_id") == session[0]) & (F.col("session_id") == session[1]))
    runs = run_agents(Tables(t.spark, {"agent_runs": mine, "sessions": t.sessions, "subagent_runs": t.subagent_runs}))
    out = runs.select(*([] if session else named(*SESSION_KEY)), *named("run_id", "agent_id", "provider", "model", "status", "started_at", "ended_at", "duration_ms"),
                      F.coalesce(F.nullif("trace_id", F.lit("")), "run_id").alias("traceId"), F.coalesce(F.nullif("span_id", F.lit("")), "run_id").alias("spanId"),
                      F.col("parent_span_id").alias("parentSpanId"))
    return out.orderBy(F.desc("startedAt"), F.desc("runId")).limit(limit) if session else out


def run_detail(t: Tables, run: tuple[str, str]) -> DataFrame:
    """One run with its calls as arrays by start time; one run is looked up, so its calls are filtered before they are gathered."""
    def of(df: DataFrame) -> DataFrame:
        return df.where((F.col("instance_id") == run[0]) & (F.col("run_id") == run[1]))

    def nested(df: DataFrame, name: str, columns: list[str], **renamed: str) -> DataFrame:
        item = F.struct("started_at", *[F.col(c).alias(renamed.get(c, camel(c))) for c in columns])
        return of(df).groupBy(*RUN_KEY).agg(F.array_sort(F.collect_list(item)).alias(name))

    base = ["status", "started_at", "ended_at", "duration_ms"]
    head = run_agents(Tables(t.spark, {"agent_runs": of(t.agent_runs), "sessions": t.sessions, "subagent_runs": t.subagent_runs}))
    out = head
    for part in (nested(t.llm_calls, "llmCalls", ["call_id", "provider", "model", *base, "input_tokens", "output_tokens", "cost_usd", "error_category"]),
                 nested(t.tool_calls, "toolCalls", ["tool_call_id", "tool_name", "tool_source", *base, "error_category"]),
                 nested(t.mcp_calls, "mcpCalls", ["call_id", "tool_name", "owner", *base, "error_category"], call_id="toolCallId")):
        out = out.join(part, RUN_KEY, "left")
    return out.select(*named("instance_id", "run_id", "session_id", "agent_id", "provider", "model", "channel", "trigger", "status", "started_at", "ended_at",
                             "duration_ms", "error_category"), "llmCalls", "toolCalls", "mcpCalls")


def run_calls(t: Tables) -> DataFrame:
    """The flat form of the run details for all runs: one row per call under its run, numbered nowhere and gathered nowhere."""
    cols = ["status", "started_at", "ended_at", "duration_ms", "error_category"]
    llm = t.llm_calls.select(*RUN_KEY, F.lit("llm").alias("kind"), F.col("call_id").alias("id"), F.col("model").alias("label"), *cols,
                             "input_tokens", "output_tokens", F.col("cost_usd").cast("double").alias("cost_usd"))
    tools = t.tool_calls.select(*RUN_KEY, F.lit("tool").alias("kind"), F.col("tool_call_id").alias("id"), F.col("tool_name").alias("label"), *cols)
    mcp = t.mcp_calls.select(*RUN_KEY, F.lit("mcp").alias("kind"), F.col("call_id").alias("id"), F.col("tool_name").alias("label"), *cols)
    calls = _fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), [llm, tools, mcp])
    runs = run_agents(t).select(*RUN_KEY, F.col("session_id"), "agent_id", F.col("status").alias("run_status"))
    return calls.join(runs, RUN_KEY)


TIMELINE = ["instance_id", "session_id", "kind", "id", "run_id", "trace_id", "span_id", "parent_span_id", "label", "provider", "model", "tool_name", "status",
            "started_at", "ended_at", "duration_ms", "error_category", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cost_usd",
            "time_to_first_byte_ms", "time_to_first_token_ms", "generation_duration_ms", "stop_reason", "attempt", "retry_reason", "request_bytes", "response_bytes"]


def timeline_spans(t: Tables, session: tuple[str, str] | None = None, columns: list[str] = TIMELINE) -> DataFrame:
    """Every span of a session, or of all: model, tool, server-tool, subagent and retry, with resolved trace and parent.

    A run supplies the trace and the parent that a call lacks, so only calls that lack one meet their run, and none where
    neither is among the ``columns``; runs are unique on their key.
    """
    def of(df: DataFrame) -> DataFrame:
        if session:
            df = df.where((F.col("instance_id") == session[0]) & (F.col("session_id") == session[1]))
        return df

    def set_(name: str) -> Column:
        return F.nullif(name, F.lit(""))

    runs = of(t.agent_runs).select(*RUN_KEY, F.col("session_id").alias("run_session"), set_("trace_id").alias("run_trace"), set_("span_id").alias("run_span"))
    none = F.lit(None).cast("string")

    def call(df: DataFrame, kind: str, key: str, label: str, **given: Column) -> DataFrame:
        return of(df).select(
            "instance_id", "session_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), "run_id", set_("trace_id").alias("trace_id"),
            F.coalesce(set_("span_id"), key).alias("span_id"), set_("parent_span_id").alias("parent_span_id"), F.coalesce(set_(label), F.lit("unknown")).alias("label"),
            "status", F.coalesce("started_at", "ended_at").alias("started_at"), "ended_at", "duration_ms", "error_category", "attempt", "retry_reason",
            *[c.alias(n) for n, c in given.items()])

    llm = call(t.llm_calls, "llm", "call_id", "model", provider=F.col("provider"), model=F.col("model"), cost_usd=F.col("cost_usd").cast("double"),
               **{c: F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "time_to_first_byte_ms", "time_to_first_token_ms",
                                        "generation_duration_ms", "stop_reason", "request_bytes", "response_bytes")})
    tools = call(t.tool_calls, "tool", "tool_call_id", "tool_name", tool_name=F.col("tool_name"))
    mcp = call(t.mcp_calls, "mcp", "call_id", "tool_name", tool_name=F.col("tool_name"))
    calls = _fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), [llm, tools, mcp]).where("started_at is not null")
    calls = calls.select(*[c for c in calls.columns if c in columns or c in (*SESSION_KEY, "run_id", "started_at")])
    from_run = {c: F.coalesce(c, *rest) for c, *rest in (("trace_id", "run_trace", "run_id", "session_id"), ("parent_span_id", "run_span", "run_id")) if c in columns}
    if from_run:
        calls = evaluated(calls, *[F.col(c) for c in calls.columns])  # both parts read the same shuffles
        lacks = _fold(or_, [F.col(c).isNull() for c in from_run])
        filled = calls.where(lacks).join(runs, RUN_KEY, "left").withColumns(from_run).select(*calls.columns)
        calls = calls.where(~lacks).unionByName(filled)
    subs = (t.subagent_runs.withColumnRenamed("parent_run_id", "run_id").join(runs, RUN_KEY).select(
        "instance_id", F.col("run_session").alias("session_id"), F.lit("subagent").alias("kind"), F.col("subagent_id").alias("id"), "run_id",
        F.coalesce(set_("trace_id"), "run_trace", "run_id").alias("trace_id"), F.coalesce(set_("span_id"), "subagent_id").alias("span_id"),
        F.coalesce(set_("parent_span_id"), "run_span", "run_id").alias("parent_span_id"), blank_to("agent_id").alias("label"), "provider", "model", "status",
        F.coalesce("started_at", "ended_at").alias("started_at"), "ended_at", ((F.unix_micros("ended_at") - F.unix_micros("started_at")) / F.lit(1000.0)).alias("duration_ms"),
        F.when(F.col("status") == "failed", blank_to("outcome")).alias("error_category")))
    retries = of(t.retry_events).select(
        "instance_id", "session_id", F.lit("retry").alias("kind"), F.col("event_id").alias("id"), "run_id", F.coalesce(set_("trace_id"), "run_id", "session_id").alias("trace_id"),
        F.coalesce(set_("span_id"), "event_id").alias("span_id"), F.coalesce(set_("parent_span_id"), "run_id").alias("parent_span_id"),
        F.coalesce(set_("to_model"), set_("to_provider"), F.lit("model retry")).alias("label"), F.col("to_provider").alias("provider"), F.col("to_model").alias("model"),
        F.lit("retried").alias("status"), F.col("occurred_at").alias("started_at"), F.col("occurred_at").alias("ended_at"), F.lit(0.0).alias("duration_ms"),
        "attempt", F.col("reason").alias("retry_reason"))
    out = _fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), [calls, subs, retries])
    present = set(out.columns)
    return out.where("started_at is not null").select(*[F.col(c) if c in present else none.alias(c) for c in columns])


def session_timeline(t: Tables, session: tuple[str, str], limit: int = 2000) -> DataFrame:
    """The first spans of one session in time order."""
    return timeline_spans(t, session).orderBy("started_at", "id", "kind").limit(limit).select(*named(*TIMELINE))


def filter_options(t: Tables) -> DataFrame:
    """Values to choose from: models, tools and states."""
    models = t.llm_calls.select(F.lit("model").alias("kind"), blank_to("model").alias("value")).distinct()
    tools = tool_events(t).select(F.lit("tool").alias("kind"), F.col("tool").alias("value")).distinct()
    states = t.spark.createDataFrame([("status", s) for s in ("active", "completed", "failed")], "kind string, value string")
    return models.unionByName(tools).unionByName(states).orderBy("kind", "value")


def context_filter(frames: dict[str, DataFrame], model: str | None = None, tool: str | None = None, status: str | None = None) -> dict[str, DataFrame]:
    """Second-level filter over dashboard frames; each frame follows the rules that fit it."""
    def keep(df: DataFrame, *conditions: Column | None) -> DataFrame:
        for c in conditions:
            df = df if c is None else df.where(c)
        return df

    m = F.col("model") == model if model else None
    s = F.col("status") == status if status else None
    rules = {
        "sessions": (s,), "llmCalls": (m, s), "subagents": (m, s), "mcpCalls": (F.col("toolName") == tool if tool else None, s),
        "models": (m,), "timeseriesModels": (m,), "tools": (F.col("tool") == tool if tool else None,), "timeseriesTools": (F.col("tool") == tool if tool else None,),
        "anomalies": ((F.col("kind") != "llm") | (F.col("label") == model) if model else None,
                      (~F.col("kind").isin("tool", "mcp")) | (F.col("label") == tool) if tool else None),
    }
    return {name: keep(df, *rules[name]) if name in rules else df for name, df in frames.items()}
