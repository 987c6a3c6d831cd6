"""Folds of the event ledger into one row per entity.

Every fold is a commutative aggregate over an explicit arrival key, so it combines on
the map side, in any order and any split: a state column is ``max`` or ``min`` of
``struct(ord, v)``, or a plain ``max``.  States of two folds merge with the same
aggregates, and ``finish`` turns a state into a projection row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import written
from ..functions.once import evaluated, evaluated_in_steps
from ..functions.ordered import running, time_slice
from ..functions.text import packed, unpacked
from ..schemas import ARRIVAL
from .usage import LARGEST, newest_calls

TEXT_LIMIT = 512


def parsed(df: DataFrame) -> DataFrame:
    return df.withColumn("_p", F.try_parse_json("payload"))


def _value(key: str, source: str) -> Column:
    if source == "_s":
        return F.col(f"_s.{key}")
    return F.try_variant_get(F.col(source) if source != "payload" else F.try_parse_json("payload"), f"$.{key}", "variant")


def payload_text(key: str, source: str = "payload") -> Column:
    """A text value cut at the limit; anything else is empty."""
    v = _value(key, source)
    return F.when(F.schema_of_variant(v) == "STRING", F.left(F.try_variant_get(v, "$", "string"), F.lit(TEXT_LIMIT))).otherwise("")


def _numeric(v: Column) -> Column:
    return F.left(F.schema_of_variant(v), F.lit(3)).isin("BIG", "DEC", "DOU", "FLO")  # bigint, decimal, double, float


def payload_number(key: str, source: str = "payload", kind: str = "double") -> Column:
    """A number; anything else is zero."""
    v = _value(key, source)
    return F.when(_numeric(v), F.try_variant_get(v, "$", kind)).otherwise(F.lit(0).cast(kind))


def payload_optional(key: str, source: str = "payload", kind: str = "double") -> Column:
    """Null when the key is absent, zero when it is there but no number."""
    return F.when(_value(key, source).isNotNull(), payload_number(key, source, kind))


def payload_count(key: str, source: str = "payload") -> Column:
    """A whole number cut towards zero."""
    return payload_number(key, source).cast("bigint")


def payload_flag(key: str, source: str = "payload") -> Column:
    v = _value(key, source)
    return (F.schema_of_variant(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean")


def arrival(order: str = "arrival") -> Column:
    """The fold order: arrival, or the documented replay order by event time."""
    names = ARRIVAL if order == "arrival" else ("occurred_at", *ARRIVAL[1:])
    return F.struct(F.col(names[0]).alias("at"), *names[1:])


@dataclass(frozen=True)
class Entity:
    """How one family of events folds: payload keys per column, by rule."""

    table: str
    families: tuple[str, ...]
    key: str
    id_keys: tuple[str, ...]
    texts: dict[str, str]                                     # last non-empty
    frozen: dict[str, str] = field(default_factory=dict)      # first arrival
    numbers: dict[str, str] = field(default_factory=dict)     # last given
    counts: dict[str, str] = field(default_factory=dict)      # last given, whole
    tops: dict[str, tuple[str, str]] = field(default_factory=dict)  # greatest, with its type
    attempts: bool = False

    def columns(self) -> list[str]:
        return ["instance_id", self.key, *self.texts, *self.frozen, "status", "started_at", "ended_at", *self.numbers, *self.counts, *self.tops,
                *(["attempt"] if self.attempts else [])]


SPAN = {"trace_id": "traceId", "span_id": "spanId", "parent_span_id": "parentSpanId"}

RUNS = Entity("agent_runs", ("agent",), "run_id", ("runId",),
              {"session_id": "sessionId", "agent_id": "agentId", "provider": "provider", "model": "model", "channel": "channel",
               "trigger": "trigger", "error_category": "errorCategory", **SPAN}, numbers={"duration_ms": "durationMs"})
LLM = Entity("llm_calls", ("llm",), "call_id", ("callId",),
             {"run_id": "runId", "session_id": "sessionId", "provider": "provider", "model": "model", "error_category": "errorCategory",
              **SPAN, "stop_reason": "stopReason", "retry_reason": "retryReason"},
             numbers={"duration_ms": "durationMs", "time_to_first_byte_ms": "timeToFirstByteMs", "time_to_first_token_ms": "timeToFirstTokenMs",
                      "generation_duration_ms": "generationDurationMs"},
             counts={"request_bytes": "requestPayloadBytes", "response_bytes": "responseStreamBytes"},
             tops={"input_tokens": ("inputTokens", "bigint"), "output_tokens": ("outputTokens", "bigint"),
                   "cache_read_tokens": ("cacheReadTokens", "bigint"), "cache_write_tokens": ("cacheWriteTokens", "bigint"),
                   "cost_usd": ("costUsd", "decimal(18,6)")}, attempts=True)
TOOLS = Entity("tool_calls", ("tool",), "tool_call_id", ("toolCallId",),
               {"run_id": "runId", "session_id": "sessionId", "tool_name": "toolName", "tool_source": "toolSource", "tool_owner": "toolOwner",
                "error_category": "errorCategory", **SPAN, "retry_reason": "retryReason"}, numbers={"duration_ms": "durationMs"}, attempts=True)
MCP = Entity("mcp_calls", ("mcp",), "call_id", ("toolCallId",),
             {"run_id": "runId", "session_id": "sessionId", "tool_name": "toolName", "owner": "toolOwner", "error_category": "errorCategory",
              **SPAN, "retry_reason": "retryReason"}, numbers={"duration_ms": "durationMs"}, attempts=True)
SUBAGENTS = Entity("subagent_runs", ("subagent",), "subagent_id", ("subagentId", "runId"),
                   {"parent_run_id": "parentRunId", "child_session_hash": "childSessionHash", "outcome": "outcome", **SPAN},
                   frozen={"agent_id": "agentId", "mode": "mode", "provider": "provider", "model": "model"})
ENTITIES = (RUNS, LLM, TOOLS, MCP, SUBAGENTS)


def of_family(ledger: DataFrame, family: str) -> DataFrame:
    return ledger.where(F.col("event_type").isin(*[f"{family}.{s}" for s in ("started", "completed", "failed")]))


def lifecycle(ledger: DataFrame, family: str) -> DataFrame:
    return parsed(of_family(ledger, family))


def _id(e: Entity) -> Column:
    return F.coalesce(*[F.nullif(payload_text(k, "_s"), F.lit("")) for k in e.id_keys])


def _attempt(source: str = "_p") -> Column:
    n = payload_count("attempt", source)
    return F.when(n > 0, n).otherwise(F.lit(1)).cast("int")


def entity_rows(ledger: DataFrame, e: Entity, order: str = "arrival", flags: dict[str, str] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """What a fold needs of every event of a family, ``flags`` (payload key by column) and ``also`` columns of the ledger;
    the id is null where the event names none."""
    flags = flags or {}
    keys = {*e.id_keys, *e.texts.values(), *e.frozen.values(), *e.numbers.values(), *e.counts.values(), *(k for k, _ in e.tops.values()), *(("attempt",) if e.attempts else ()), *flags.values()}
    # one pass over the text takes out all keys, each as a variant that still knows its type
    fields = F.from_json("payload", f"struct<{', '.join(f'{k}: variant' for k in sorted(keys))}>")
    events = of_family(ledger, e.families[0]).withColumn("_s", fields)
    started = F.col("event_type").endswith("started")
    made = {c: payload_text(k, "_s") for c, k in {**e.texts, **e.frozen}.items()}
    made |= {c: payload_optional(k, "_s") for c, k in e.numbers.items()}
    made |= {c: payload_optional(k, "_s").cast("bigint") for c, k in e.counts.items()}
    made |= {c: payload_count(k, "_s") if kind == "bigint" else payload_number(k, "_s", kind) for c, (k, kind) in e.tops.items()}
    if e.attempts:
        made["attempt"] = _attempt("_s")
    made = {e.key: _id(e), "_ord": arrival(order), "_started": started,
            "_status": F.when(started, "active").when(F.col("event_type").endswith("failed"), "failed").otherwise("completed"),
            **made, **{n: F.coalesce(payload_flag(k, "_s"), F.lit(False)) for n, k in flags.items()}}
    kept = ["instance_id", "occurred_at", *also]
    given = events.select(*dict.fromkeys([*kept, "event_type", *ARRIVAL, "_s"]))
    return evaluated_in_steps(given, kept, made)


def fold(ledger: DataFrame, e: Entity, order: str = "arrival") -> DataFrame:
    """State of every entity named in the ledger; events without an id are left out."""
    return fold_rows(entity_rows(ledger, e, order), e)


def fold_rows(rows: DataFrame, e: Entity) -> DataFrame:
    rows = rows.where(F.col(e.key).isNotNull())

    def stamped(value: Column) -> Column:
        return F.struct(F.col("_ord").alias("ord"), value.alias("v"))

    open_, closed = F.col("_started"), ~F.col("_started")
    aggs = [F.max(F.when(F.col(c) != "", stamped(F.col(c)))).alias(c) for c in e.texts]
    aggs += [F.min(stamped(F.col(c))).alias(c) for c in e.frozen]
    aggs += [F.max(F.when(F.col(c).isNotNull(), stamped(F.col(c)))).alias(c) for c in (*e.numbers, *e.counts)]
    aggs += [F.max(c).alias(c) for c in (*e.tops, *(["attempt"] if e.attempts else []))]
    aggs += [F.max(F.when(closed, stamped(F.col("_status")))).alias("status"),
             F.min(F.when(open_, stamped(F.col("occurred_at")))).alias("started_at"),
             F.max(F.when(closed, stamped(F.col("occurred_at")))).alias("ended_at")]
    return rows.groupBy("instance_id", e.key).agg(*aggs).select(*e.columns())


def fold_dealt(rows: DataFrame, e: Entity, order: str = "arrival", largest: int = LARGEST) -> DataFrame:
    """The same states, of rows that can be read twice: rows are dealt by entity before they become states.

    A state names the arrival of each of its columns, so it is wider than the few rows most entities have.  Entities of more
    than ``largest`` rows, which a count finds first, are combined before they are dealt.
    """
    key = ["instance_id", e.key]
    rows = rows.where(F.col(e.key).isNotNull())
    name = F.xxhash64(*key).alias("_name")
    big = written(rows.select(name).groupBy("_name").count().where(F.col("count") > largest).select("_name"))
    some = not big.isEmpty()
    few = rows.withColumn("_name", name).join(big, "_name", "left_anti").drop("_name") if some else rows
    few = few.drop("_ord").withColumn("event_id", packed(F.col("event_id"))).repartition(*key).withColumn("event_id", unpacked(F.col("event_id"))).withColumn("_ord", arrival(order))
    out = fold_rows(few, e)
    return out.unionByName(fold_rows(rows.withColumn("_name", name).join(big, "_name", "left_semi"), e)) if some else out


def merge_states(states: DataFrame, e: Entity) -> DataFrame:
    """Combines several state rows of one entity; associative, commutative and idempotent."""
    first = {*e.frozen, "started_at"}
    return states.groupBy("instance_id", e.key).agg(
        *[(F.min if c in first else F.max)(c).alias(c) for c in e.columns()[2:]])


def finish(state: DataFrame, e: Entity) -> DataFrame:
    out = ["instance_id", e.key]
    out += [F.coalesce(F.col(c + ".v"), F.lit("")).alias(c) for c in (*e.texts, *e.frozen)]
    out += [F.coalesce(F.col("status.v"), F.lit("active")).alias("status"), F.col("started_at.v").alias("started_at"), F.col("ended_at.v").alias("ended_at")]
    out += [F.col(c + ".v").alias(c) for c in (*e.numbers, *e.counts)]
    return state.select(*out, *e.tops, *(["attempt"] if e.attempts else []))


def reduce_runs(ledger: DataFrame, order: str = "arrival") -> DataFrame:
    return finish(fold(ledger, RUNS, order), RUNS)


def reduce_tools(ledger: DataFrame, order: str = "arrival") -> DataFrame:
    return finish(fold(ledger, TOOLS, order), TOOLS)


def reduce_mcp(ledger: DataFrame, order: str = "arrival") -> DataFrame:
    return finish(fold(ledger, MCP, order), MCP)


def reduce_subagents(ledger: DataFrame, order: str = "arrival") -> DataFrame:
    return finish(fold(ledger, SUBAGENTS, order), SUBAGENTS)


def reduce_llm_calls(ledger: DataFrame, order: str = "arrival", usage: bool = True) -> DataFrame:
    """Model calls; ``usage`` also raises counters by usage records that name only a run.  The ledger is read once."""
    if not usage:
        return finish(fold(ledger, LLM, order), LLM)
    rows = call_rows(ledger, order)
    # a raised call has a row of its own; its few counters meet that row, and wide states are combined once
    raised = usage_states(match_usage_rows(usage_rows(rows))).select("instance_id", "call_id", *[F.col(c).alias("_raised_" + c) for c in COUNTERS])
    calls = finish(fold_dealt(rows, LLM, order), LLM)
    return calls.join(raised, ["instance_id", "call_id"], "left").select(*[F.greatest(c, "_raised_" + c).alias(c) if c in COUNTERS else c for c in calls.columns])


# --- usage records without a call id -------------------------------------------------

COUNTERS = list(LLM.tops)


def call_rows(ledger: DataFrame, order: str = "arrival") -> DataFrame:
    """What folds and matching need of every model event, written once since it is read several times.

    The arrival key is made of the columns it repeats after reading, and the codec shortens ids, which are random digits.
    """
    return written(_call_rows(ledger, order).drop("_ord"), "zstd").withColumn("_ord", arrival(order))


def _call_rows(ledger: DataFrame, order: str = "arrival") -> DataFrame:
    return entity_rows(ledger, LLM, order, {"update": "accountingUpdate"}, ARRIVAL)


def usage_rows(rows: DataFrame) -> DataFrame:
    """The part of ``call_rows`` that matching needs: events of calls, and records that name a run only."""
    started = F.col("_started")
    return rows.where("call_id is not null or (update and run_id <> '')").select(
        "instance_id", *ARRIVAL, F.coalesce("call_id", F.lit("")).alias("call_id"), "run_id", "provider", "model", "update",
        F.when(started, F.col("occurred_at")).alias("start"), F.when(~started, F.col("occurred_at")).alias("end"), *COUNTERS)


def usage_updates(rows: DataFrame) -> DataFrame:
    return rows.where("call_id = '' and update").select("instance_id", *ARRIVAL, "run_id", "provider", "model", *COUNTERS)


def match_usage(ledger: DataFrame) -> DataFrame:
    return match_usage_rows(written(usage_rows(_call_rows(ledger)), "zstd"))


def match_usage_rows(rows: DataFrame, earlier: DataFrame | None = None, largest: int = LARGEST) -> DataFrame:
    """Each usage record with the call it raises: the run's newest call known at its arrival, of the
    provider and model it names.  ``earlier`` are rows of calls known before, one per call."""
    events = rows.where("call_id <> ''").select("instance_id", "call_id", *ARRIVAL, "run_id", "provider", "model", "start", "end")
    records = usage_updates(rows).select("instance_id", *ARRIVAL, "run_id", "provider", "model", F.struct(*COUNTERS).alias("raise"))
    found = newest_calls(events if earlier is None else events.unionByName(earlier), records, largest)
    return found.select("instance_id", "event_id", "run_id", "call_id", "raise.*")


def usage_states(matches: DataFrame) -> DataFrame:
    """The raises as partial call states: only the counters are set."""
    return matches.groupBy("instance_id", "call_id").agg(*[F.max(c).alias(c) for c in COUNTERS])


# --- sessions ------------------------------------------------------------------------

SESSION_STATE = ["status", "started_at", "ended_at", "end_reason", "message_count", "agent_id", "hash_of_start", "first_hash"]


def fold_sessions(ledger: DataFrame, order: str = "arrival") -> DataFrame:
    started = F.col("event_type").endswith("started")
    rows = evaluated(lifecycle(ledger, "session"), F.col("instance_id"), payload_text("sessionId", "_p").alias("session_id"), arrival(order).alias("_ord"),
                     F.col("occurred_at"), started.alias("_started"), F.when(started, "active").when(F.col("event_type").endswith("failed"), "failed").otherwise("completed").alias("_status"),
                         payload_text("agentId", "_p").alias("agent_id"), payload_text("sessionKeyHash", "_p").alias("_hash"),
                         payload_text("reason", "_p").alias("end_reason"), payload_count("messageCount", "_p").alias("message_count")).where("session_id <> ''")

    def stamped(name: str) -> Column:
        return F.struct(F.col("_ord").alias("ord"), F.col(name).alias("v"))

    open_, closed = F.col("_started"), ~F.col("_started")
    return rows.groupBy("instance_id", "session_id").agg(
        F.max(stamped("_status")).alias("status"), F.min(F.when(open_, stamped("occurred_at"))).alias("started_at"),
        F.max(F.when(closed, stamped("occurred_at"))).alias("ended_at"), F.max(F.when(closed, stamped("end_reason"))).alias("end_reason"),
        F.max(F.when(closed, stamped("message_count"))).alias("message_count"), F.max(F.when(F.col("agent_id") != "", stamped("agent_id"))).alias("agent_id"),
        F.max(F.when(open_ & (F.col("_hash") != ""), stamped("_hash"))).alias("hash_of_start"), F.min(stamped("_hash")).alias("first_hash"))


def merge_session_states(states: DataFrame) -> DataFrame:
    first = {"started_at", "first_hash"}
    return states.groupBy("instance_id", "session_id").agg(*[(F.min if c in first else F.max)(c).alias(c) for c in SESSION_STATE])


def finish_sessions(state: DataFrame) -> DataFrame:
    return state.select("instance_id", "session_id", F.coalesce("hash_of_start.v", "first_hash.v").alias("session_key_hash"),
                        F.coalesce(F.col("agent_id.v"), F.lit("")).alias("agent_id"), F.col("status.v").alias("status"),
                        F.col("started_at.v").alias("started_at"), F.col("ended_at.v").alias("ended_at"),
                        F.col("end_reason.v").alias("end_reason"), F.coalesce("message_count.v", F.lit(0)).alias("message_count"))


def reduce_sessions(ledger: DataFrame, order: str = "arrival") -> DataFrame:
    """A start always reopens a session, unlike runs and calls, which never leave an end state."""
    return finish_sessions(fold_sessions(ledger, order))


# --- instances -----------------------------------------------------------------------

INSTANCE_STATE = ["start", "process", "standing", "turn", "last_sample"]


def fold_instances(ledger: DataFrame, earlier: DataFrame | None = None, runtime_key: str = "runtimeVersion") -> DataFrame:
    """State of every instance; ``earlier`` is the state before this ledger, whose events all arrive later.

    A stop counts only after a first start or heartbeat, and only when no newer start is known.  The
    start a stop meets comes from a sliced scan over starts and stops; everything else only combines.
    """
    order = list(ARRIVAL)
    stamp = F.struct(F.col("received_at").alias("at"), *order[1:])
    rows = parsed(ledger.where("event_type like 'gateway.%'")).select(
        "instance_id", *order, stamp.alias("ord"), F.split_part("event_type", F.lit("."), F.lit(2)).alias("kind"), "occurred_at", "process_id",
        payload_text("pluginVersion", "_p").alias("plugin_version"), payload_text(runtime_key, "_p").alias("runtime_version"))
    is_start = F.col("kind") == "started"
    nothing = F.lit(None).cast("timestamp")

    def state(status: Column, stopped: Column) -> Column:
        return F.struct("ord", F.struct(status.alias("status"), F.col("occurred_at").alias("at"), stopped.alias("stopped_at")).alias("v"))

    lives = rows.where("kind in ('started', 'heartbeat')").groupBy("instance_id").agg(
        F.min("ord").alias("born"),
        F.max(F.when(is_start, F.struct("ord", F.struct("plugin_version", "runtime_version", F.col("occurred_at").alias("at")).alias("v")))).alias("start"),
        F.max(F.when(is_start | F.col("process_id").isNotNull(), F.struct("ord", F.col("process_id").alias("v")))).alias("process"),
        F.max(state(F.lit("up"), nothing)).alias("standing"), F.max(F.when(is_start, state(F.lit("up"), nothing))).alias("turn"))
    turns = rows.where("kind <> 'heartbeat'").select("instance_id", *order, "ord", "kind", "occurred_at")
    if earlier is not None:
        kept = earlier.where("start is not null").select(
            "instance_id", F.col("start.ord.at").alias("received_at"), *[F.col("start.ord." + c).alias(c) for c in order[1:]],
            F.col("start.ord").alias("ord"), F.lit("started").alias("kind"), F.col("start.v.at").alias("occurred_at"))
        turns = turns.unionByName(kept)
    turns = running(turns, ["instance_id"], order, time_slice("received_at"), {"since": ("last", F.when(is_start, F.col("occurred_at")))})
    stops = (turns.where("kind in ('stopped', 'crashed') and (since is null or since <= occurred_at)")
             .groupBy("instance_id").agg(F.max(state(F.col("kind"), F.col("occurred_at"))).alias("stop")))
    if earlier is not None:
        old = earlier.select("instance_id", F.col("standing.ord").alias("born"), *INSTANCE_STATE[:4])
        lives = (lives.unionByName(old).groupBy("instance_id")
                 .agg(F.min("born").alias("born"), *[F.max(c).alias(c) for c in INSTANCE_STATE[:4]]))
    counted = F.when(F.col("stop.ord") > F.col("born"), F.col("stop"))
    standing = (lives.join(stops, "instance_id", "left")
                .select("instance_id", "start", "process", F.greatest("standing", counted).alias("standing"), F.greatest("turn", counted).alias("turn")))
    seen = last_samples(ledger, standing)
    out = standing.join(seen, "instance_id", "left")
    if earlier is not None:
        before = earlier.select("instance_id", F.col("standing.ord").alias("_was"), F.col("last_sample").alias("_sample"))
        out = (out.join(before, "instance_id", "left")
               .withColumn("last_sample", F.greatest("last_sample", F.when(F.col("_was") == F.col("standing.ord"), F.col("_sample")))))
    return out.select("instance_id", *INSTANCE_STATE)


def last_samples(ledger: DataFrame, standing: DataFrame) -> DataFrame:
    """Newest sample time after each instance's standing event.

    Whole hours after it are one row each before they meet the instances; only its own hour is compared by row.
    """
    samples = (ledger.where("event_type = 'resource.sampled'")
               .select("instance_id", "occurred_at", F.struct(F.col("received_at").alias("at"), *ARRIVAL[1:]).alias("ord"), time_slice("received_at").alias("_hour")))
    after = standing.select("instance_id", F.col("standing.ord").alias("_ord")).withColumn("_from", time_slice("_ord.at"))
    hours = (samples.groupBy("instance_id", "_hour").agg(F.max("occurred_at").alias("at"))
             .join(after, "instance_id").where("_hour > _from").select("instance_id", "at"))
    same = (samples.join(after.withColumnRenamed("_from", "_hour"), ["instance_id", "_hour"]).where("ord > _ord")
            .select("instance_id", F.col("occurred_at").alias("at")))
    return hours.unionByName(same).groupBy("instance_id").agg(F.max("at").alias("last_sample"))


def finish_instances(state: DataFrame) -> DataFrame:
    return state.select("instance_id", F.coalesce("start.v.plugin_version", F.lit("")).alias("plugin_version"),
                        F.coalesce("start.v.runtime_version", F.lit("")).alias("runtime_version"), F.col("process.v").cast("int").alias("process_id"),
                        F.col("standing.v.status").alias("status"), F.col("start.v.at").alias("started_at"),
                        F.greatest("standing.v.at", "last_sample").alias("last_seen_at"), F.col("turn.v.stopped_at").alias("stopped_at"))


def reduce_instances(ledger: DataFrame, runtime_key: str = "runtimeVersion") -> DataFrame:
    return finish_instances(fold_instances(ledger, None, runtime_key))


# --- one row per event ---------------------------------------------------------------

def reduce_retries(ledger: DataFrame) -> DataFrame:
    events = parsed(ledger.where("event_type = 'llm.retried'"))
    texts = {"session_id": "sessionId", "run_id": "runId", **SPAN, "from_provider": "fromProvider", "from_model": "fromModel",
             "to_provider": "toProvider", "to_model": "toModel"}
    return events.select("event_id", "instance_id", *[payload_text(k, "_p").alias(c) for c, k in texts.items()],
                         _attempt().alias("attempt"), payload_text("reason", "_p").alias("reason"), "occurred_at")


def reduce_samples(ledger: DataFrame) -> DataFrame:
    events = parsed(ledger.where("event_type = 'resource.sampled'"))
    whole = {"resident_memory_bytes": "residentMemoryBytes", "virtual_memory_bytes": "virtualMemoryBytes", "threads": "threads", "open_fds": "openFds",
             "read_bytes": "readBytesTotal", "write_bytes": "writeBytesTotal", "disk_total_bytes": "diskTotalBytes", "disk_available_bytes": "diskAvailableBytes"}
    return events.select("event_id", "instance_id", F.col("process_id").cast("int").alias("process_id"), F.col("occurred_at").alias("sampled_at"),
                         payload_number("cpuSecondsTotal", "_p").alias("cpu_seconds_total"),
                         *[payload_count(k, "_p").alias(c) for c, k in whole.items()])


REDUCERS = {"instances": reduce_instances, "sessions": reduce_sessions, "agent_runs": reduce_runs, "llm_calls": reduce_llm_calls,
            "tool_calls": reduce_tools, "mcp_calls": reduce_mcp, "subagent_runs": reduce_subagents, "retry_events": reduce_retries,
            "resource_samples": reduce_samples}


def rebuild(ledger: DataFrame) -> dict[str, DataFrame]:
    """Every projection from a whole, de-duplicated ledger."""
    return {name: fn(ledger) for name, fn in REDUCERS.items()}


# --- repairs over the projections ----------------------------------------------------

def backfill_agent_id(ledger: DataFrame, sessions: DataFrame, runs: DataFrame, subagents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, runs) with empty agent ids filled: from the newest ledger event of the entity that has a
    text agent id, runs then from their session, then from the subagent of the same id."""
    def named(family: str, id_key: str, column: str) -> DataFrame:
        events = lifecycle(ledger, family)
        v = F.try_variant_get("_p", "$.agentId", "variant")
        events = events.where(F.schema_of_variant(v) == "STRING").withColumn(column, payload_text(id_key, "_p"))
        return events.groupBy("instance_id", column).agg(
            F.nullif(F.max_by(F.trim(F.try_variant_get(v, "$", "string")), F.struct("occurred_at", "sequence", "event_id")), F.lit("")).alias("_named"))

    def fill(df: DataFrame, *names: str) -> DataFrame:
        return df.withColumn("agent_id", F.coalesce(F.nullif("agent_id", F.lit("")), *names)).drop(*names)

    sessions = fill(sessions.join(named("session", "sessionId", "session_id"), ["instance_id", "session_id"], "left"), "_named")
    runs = fill(runs.join(named("agent", "runId", "run_id"), ["instance_id", "run_id"], "left")
                .join(sessions.select("instance_id", "session_id", F.nullif("agent_id", F.lit("")).alias("_session")), ["instance_id", "session_id"], "left")
                .join(subagents.select("instance_id", F.col("subagent_id").alias("run_id"), F.nullif("agent_id", F.lit("")).alias("_sub")), ["instance_id", "run_id"], "left"),
                "_named", "_session", "_sub")
    return sessions, runs


def detect_crashes(probes: DataFrame, misses: int = 3) -> DataFrame:
    """A crash for every ``misses`` failed probes in a row, and at once for a missing process; both reset the count."""
    key, order, cut = ["instance_id"], ["probed_at", "probe_id"], time_slice("probed_at")
    gone = ~F.col("ok") & F.col("missing")
    failed = ~F.col("ok") & ~F.col("missing")
    rows = running(probes.withColumn("_gone", gone).withColumn("_failed", failed), key, order, cut, {"_count": ("sum", F.col("_failed").cast("bigint"))})
    rows = running(rows, key, order, cut, {"_base": ("last", F.when(~F.col("_failed"), F.col("_count")))})
    streak = F.col("_count") - F.coalesce("_base", F.lit(0))
    hit = F.col("_gone") | (F.col("_failed") & (streak % misses == 0))
    return rows.where(hit).select("instance_id", "probed_at", "probe_id", F.when(F.col("_gone"), "process_missing").otherwise("sampling_failed").alias("reason"),
                                  F.when(F.col("_failed"), F.lit(misses)).cast("bigint").alias("failure_count"))


def reconcile_liveness(rows: DataFrame, instances: DataFrame) -> DataFrame:
    """Active rows of a stopped or crashed instance become ``incomplete``."""
    dead = instances.where("status in ('stopped', 'crashed')").select("instance_id", F.lit(True).alias("_dead"))
    return (rows.join(dead, "instance_id", "left")
            .withColumn("status", F.when((F.col("status") == "active") & F.col("_dead"), "incomplete").otherwise(F.col("status"))).drop("_dead"))
