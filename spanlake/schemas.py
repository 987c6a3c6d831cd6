"""Envelope schema and the closed lists around it."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: protocol version, limits, event types
SCHEMA_VERSION = 1
MAX_EVENT_BYTES = 16 * 1024
MAX_BATCH_BYTES = 1024 * 1024
MAX_BATCH_EVENTS = 1000
FUTURE_HOURS = 24
STATES = ("started", "completed", "failed")
ENTITIES = ("session", "agent", "llm", "tool", "mcp", "subagent")
EVENT_TYPES = (
    "gateway.started", "gateway.heartbeat", "gateway.stopped", "gateway.crashed",
    *(f"{e}.{s}" for e in ENTITIES for s in STATES),
    "llm.retried", "resource.sampled", "monitor.events_dropped", "monitor.plugin_error",
)

# an envelope as it arrives in a file: one element of a JSON array
WIRE = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()), T.StructField("eventId", T.StringType()), T.StructField("eventType", T.StringType()),
    T.StructField("occurredAt", T.StringType()), T.StructField("monotonicTimeNs", T.LongType()), T.StructField("instanceId", T.StringType()),
    T.StructField("producerId", T.StringType()), T.StructField("processId", T.LongType()), T.StructField("sequence", T.LongType()),
    T.StructField("source", T.StringType()), T.StructField("payload", T.StringType()),
])

# wire name -> column of the ledger
LEDGER_COLUMNS = {
    "schemaVersion": "schema_version", "eventId": "event_id", "eventType": "event_type", "occurredAt": "occurred_at",
    "monotonicTimeNs": "monotonic_time_ns", "instanceId": "instance_id", "producerId": "producer_id", "processId": "process_id",
    "sequence": "sequence", "source": "source", "payload": "payload",
}
ARRIVAL = ("received_at", "producer_id", "sequence", "event_id")
