"""Continuous intake: batches in, ledger and projections out, and live views of the same events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.filters import BUCKETS
from ..operators.merge import StateStore
from ..operators.reduce import payload_number, payload_text
from ..operators.retention import SATURATED
from ..sources.events import accepted

REPEAT_WINDOW = "7 days"
LATE = "24 hours"


def unique_events(batches: DataFrame, now: str | None = None, horizon: str = REPEAT_WINDOW) -> DataFrame:
    """Events of accepted batches, each id once.  The horizon runs on arrival, so late events are never dropped."""
    return accepted(batches, now).withWatermark("received_at", horizon).dropDuplicatesWithinWatermark(["event_id"])


def start_ingest(batches: DataFrame, root: str, checkpoint: str, now: str | None = None, **trigger) -> StreamingQuery:
    """Merges every micro-batch into the store; a repeated micro-batch is skipped, repeats older than the
    horizon meet the ledger there."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        # The id of the query lives in its checkpoint: with a new checkpoint the numbers start again under another id.
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        StateStore(batch.sparkSession, root).merge(batch, batch_id, stream)

    return (unique_events(batches, now).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def live_tail(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Every newly inserted event once, appended as it comes."""
    return (events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"availableNow": True})).start())


def event_pulse(events: DataFrame) -> DataFrame:
    """Running counts of unique events by type (complete or update mode)."""
    return events.groupBy("event_type").agg(F.count("*").alias("events"))


def stream_timeseries(events: DataFrame, bucket: str, late: str = LATE) -> DataFrame:
    """Runs, model and tool calls started per tumbling bucket; later rows than the watermark are left to the batch series."""
    def of(*names: str):
        return F.count_if(F.col("event_type").isin(*names))

    started = events.withWatermark("occurred_at", late)
    return (started.groupBy(F.window("occurred_at", f"{BUCKETS[bucket]} seconds").alias("w"))
            .agg(of("agent.started").alias("runs"), of("llm.started").alias("llmRequests"), of("tool.started", "mcp.started").alias("toolCalls"))
            .select(F.col("w.start").alias("time"), "runs", "llmRequests", "toolCalls"))


def sliding_counts(events: DataFrame, length: str = "5 minutes", slide: str = "15 seconds", late: str = LATE) -> DataFrame:
    """Events per type over a sliding window and their rate per second."""
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return (events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", length, slide).alias("w"), "event_type")
            .agg(F.count("*").alias("events")).select(F.col("w.end").alias("at"), "event_type", "events", (F.col("events") / seconds).alias("rate")))


ENTITY_OF = {"agent": "runId", "llm": "callId", "tool": "toolCallId", "mcp": "toolCallId", "session": "sessionId", "subagent": "subagentId"}


def lifecycle_rows(events: DataFrame) -> DataFrame:
    """(instance_id, kind, id, state, arrival) of the events that name an entity."""
    kind = F.split_part("event_type", F.lit("."), F.lit(1))
    ident = F.lit(None).cast("string")
    for family, key in ENTITY_OF.items():
        value = F.nullif(payload_text(key), F.lit(""))
        if family == "subagent":
            value = F.coalesce(value, F.nullif(payload_text("runId"), F.lit("")))
        ident = F.when(kind == family, value).otherwise(ident)
    return (events.select("instance_id", kind.alias("kind"), ident.alias("id"), F.split_part("event_type", F.lit("."), F.lit(2)).alias("state"),
                          "received_at", "producer_id", "sequence", "event_id").where("id is not null and state in ('started', 'completed', 'failed')"))


class Lifecycle(StatefulProcessor):
    """Keeps one entity's status.  The last end by arrival wins; for a session a later start reopens it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._status = handle.getValueState("status", "status string, at timestamp, producer string, sequence bigint, event string")

    def handleInputRows(self, key, rows, timerValues):
        instance, kind, ident = key
        held = self._status.get() if self._status.exists() else None
        status, order = (held[0], (pd.Timestamp(held[1]), held[2], held[3], held[4])) if held else (None, None)
        before = status
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                arrival = (pd.Timestamp(r.received_at), r.producer_id, r.sequence, r.event_id)
                if r.state == "started" and kind != "session":
                    status = status or "active"
                elif order is None or arrival > order:
                    status, order = ("active" if r.state == "started" else r.state), arrival
        at, producer, sequence, event = order or (pd.Timestamp(0), "", -1, "")
        self._status.update((status, at.to_pydatetime(), producer, int(sequence), event))
        if status != before:
            yield pd.DataFrame({"instance_id": [instance], "kind": [kind], "id": [ident], "status": [status]})

    def close(self) -> None:
        pass


def stream_lifecycle(events: DataFrame) -> DataFrame:
    """Status changes per entity.  Needs the RocksDB state store provider."""
    return lifecycle_rows(events).groupBy("instance_id", "kind", "id").transformWithStateInPandas(
        Lifecycle(), "instance_id string, kind string, id string, status string", "Update", "None")


class Pressure(StatefulProcessor):
    """Remembers whether an instance's queue was saturated and emits the edges."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._was = handle.getValueState("was", "saturated boolean")

    def handleInputRows(self, key, rows, timerValues):
        was = bool(self._was.get()[0]) if self._was.exists() else False
        edges = []
        for r in sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: (r.received_at, r.sequence)):
            now = r.depth >= r.capacity * SATURATED
            if now != was:
                edges.append((key[0], r.event_id, "saturated" if now else "recovered"))
            was = now
        self._was.update((was,))
        if edges:
            yield pd.DataFrame(edges, columns=["instance_id", "event_id", "edge"])

    def close(self) -> None:
        pass


def stream_backpressure(events: DataFrame) -> DataFrame:
    beats = events.where("event_type = 'gateway.heartbeat'").select(
        "instance_id", "event_id", "received_at", "sequence", payload_number("queueDepth").alias("depth"), payload_number("queueCapacity").alias("capacity")).where("capacity > 0")
    return beats.groupBy("instance_id").transformWithStateInPandas(Pressure(), "instance_id string, event_id string, edge string", "Update", "None")


def start_refresh(events: DataFrame, refresh, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Calls ``refresh(batch, batch_id)`` at most once per interval, however many events came."""
    return events.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
