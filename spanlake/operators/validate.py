"""Validation, batch verdicts, de-duplication and ledger checks."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.once import evaluated
from ..functions.ordered import SEQUENCE_SLICE, previous, running
from ..functions.text import packed, unpacked
from ..schemas import EVENT_TYPES, FUTURE_HOURS, MAX_BATCH_EVENTS, MAX_EVENT_BYTES, SCHEMA_VERSION
from .filters import instant

IDENTITY = "^[A-Za-z0-9._:-]{1,128}$"
ENVELOPE_BYTES = 1024  # more than all other fields of an event with valid ids can take
KEY_PATTERN = "^[A-Za-z][A-Za-z0-9_]*$"


def serialized_bytes(payload: Column, of=F.col) -> Column:
    """Size of the whole event as JSON text with the given payload text."""
    quoted = [('{"schemaVersion":', of("schema_version").cast("string")), (',"eventId":"', of("event_id")), ('","eventType":"', of("event_type")),
              ('","occurredAt":"', F.date_format(of("occurred_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), ('","instanceId":"', of("instance_id")),
              ('","producerId":"', of("producer_id")), ('","sequence":', of("sequence").cast("string")), (',"source":"', of("source"))]
    fixed = sum(len(text) for text, _ in quoted) + len('","payload":}')
    size = F.lit(fixed) + F.octet_length(payload)
    for _, value in quoted:
        size = size + F.coalesce(F.octet_length(value), F.lit(0))
    return size + F.when(of("process_id").isNotNull(), F.length(of("process_id").cast("string")) + len(',"processId":')).otherwise(0)


def rejection(now: str | None = None, of=F.col) -> Column:
    """Name of the first failing rule, null for a valid event; ``of`` gives a field, by default a column."""
    clock = instant(now) if now else F.current_timestamp()
    size = F.octet_length(of("event_id"))
    payload = of("payload")

    def fails(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    return (F.when(fails(of("schema_version") == SCHEMA_VERSION), "schema_version")
            .when(fails(size.between(32, 64)), "event_id")
            .when(fails(of("event_type").isin(*EVENT_TYPES)), "event_type")
            .when(fails((F.unix_micros(of("occurred_at")) >= 0) & (of("occurred_at") <= clock + F.expr(f"interval {FUTURE_HOURS} hours"))), "occurred_at")
            .when(fails(of("instance_id").rlike(IDENTITY) & of("producer_id").rlike(IDENTITY)), "identity")
            .when(fails(of("source").isin("plugin", "daemon")), "source")
            .when(of("process_id").isNotNull() & ~of("process_id").between(1, 2**31 - 1), "process_id")
            .when(fails(F.startswith(payload, F.lit("{")) & F.try_parse_json(payload).isNotNull()), "payload")
            .when((F.octet_length(payload) > MAX_EVENT_BYTES - ENVELOPE_BYTES) & (serialized_bytes(payload, of) > MAX_EVENT_BYTES)
                  & (serialized_bytes(F.to_json(F.try_parse_json(payload)), of) > MAX_EVENT_BYTES), "size"))


def with_reason(df: DataFrame, now: str | None = None) -> DataFrame:
    return evaluated(df, *[F.col(c) for c in df.columns], rejection(now).alias("reason"))


def validate_events(df: DataFrame, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected events with their reason)."""
    checked = with_reason(df, now)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def _deep_problem(texts: pd.Series) -> pd.Series:
    """First rule of nested values a payload breaks: text over 4096, list over 128, object over 64 keys, key over 64."""
    def one(text):
        try:
            open_values = [(json.loads(text), True)]
        except (ValueError, RecursionError):
            return None
        while open_values:
            value, top = open_values.pop()
            if isinstance(value, str) and len(value) > 4096:
                return "string_length"
            if isinstance(value, list):
                if len(value) > 128:
                    return "array_length"
                open_values.extend((v, False) for v in reversed(value))
            elif isinstance(value, dict):
                if not top and len(value) > 64:
                    return "object_size"
                if not top and any(len(k) > 64 for k in value):
                    return "key_length"
                open_values.extend((v, False) for v in reversed(value.values()))
        return None
    return texts.map(one)


def contract_check(df: DataFrame, unknown_keys: str | None = None) -> DataFrame:
    """(event_id, rule) for schema rules beyond validation.

    Keys are checked on the JVM.  Only payloads that nest or are long enough to break a deep rule
    go through Arrow batches, since values may nest to any depth.
    """
    keys = F.json_object_keys("payload")
    rules = [
        ("sequence", F.col("sequence") < 0),
        ("payload_size", F.size(keys) > 64),
        ("payload_key", F.exists(keys, lambda k: (F.length(k) > 64) | ~k.rlike(KEY_PATTERN))),
    ]
    if unknown_keys:
        rules.append(("unknown_key", F.size(unknown_keys) > 0))
    hits = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
    flat = df.select("event_id", F.explode(hits).alias("rule"))
    deep = F.pandas_udf(_deep_problem, "string")
    nested = (df.where(F.try_parse_json("payload").isNotNull() & (F.col("payload").rlike("^\\{[^\\[{]*[\\[{]") | (F.length("payload") > 4096)))
              .select("event_id", deep("payload").alias("rule")).where("rule is not null"))
    return flat.unionByName(nested)


def batch_verdicts(df: DataFrame, now: str | None = None) -> DataFrame:
    """One row per batch: its size, its bad events and whether it is taken."""
    out = with_reason(df, now).groupBy("batch_id").agg(F.count("*").alias("events"), F.count("reason").alias("bad"))
    taken = (F.col("bad") == 0) & F.col("events").between(1, MAX_BATCH_EVENTS)
    return out.withColumn("verdict", F.when(taken, "accepted").otherwise("rejected"))


def reject_bad_batches(df: DataFrame, now: str | None = None) -> DataFrame:
    """Events of accepted batches; one bad event, or too many events, reject the whole batch."""
    good = batch_verdicts(df, now).where("verdict = 'accepted'").select("batch_id")
    return df.join(good, "batch_id", "left_semi")


def in_families(*families: str) -> Column:
    """Whether the part of the event type before its first dot is one of the names; nothing is split."""
    kind = F.col("event_type")
    return reduce(or_, [F.startswith(kind, F.lit(name + ".")) | (kind == name) for name in families])


def dedup_events(df: DataFrame, columns: list[str] | None = None, of: tuple[str, ...] | None = None) -> DataFrame:
    """The first arrival of each event id, with all or the named columns.

    Any number of copies shrinks to one per task before the shuffle.  Whole rows are combined as a minimum per id.  With
    named columns the copies of an id are ordered by arrival and limited to the first, before the shuffle and after it,
    which sorts rows as they are and makes no states; ids travel as bytes, and what is not asked for is not carried: other
    columns, and of families outside of ``of`` all but the id and the order of arrival (null then).  Copies that arrive
    together are ranked by a hash of all other columns, so every form keeps the same copy.
    """
    lead = [c for c in ("received_at", "producer_id", "sequence", "batch_id") if c in df.columns]
    rest = [c for c in df.columns if c not in lead and c != "event_id"]
    tie = [F.xxhash64(*rest).alias("_tie")] if rest else []
    if columns is None:
        first = df.groupBy("event_id").agg(F.min(F.struct(*lead, *tie, *rest)).alias("_first"))
        return first.select(*[F.col("event_id") if c == "event_id" else F.col("_first." + c).alias(c) for c in df.columns])
    carried = [F.when(in_families(*of), F.col(c)).alias(c) if of and c not in lead else F.col(c) for c in df.columns
               if (c in columns or c in lead) and c != "event_id"]
    order = W.partitionBy("_id").orderBy(*lead, *(["_tie"] if rest else []))
    first = df.select(packed(F.col("event_id")).alias("_id"), *carried, *tie).withColumn("_copy", F.row_number().over(order)).where("_copy = 1")
    return first.select(*[unpacked(F.col("_id")).alias(c) if c == "event_id" else c for c in columns])


def ingest_report(df: DataFrame) -> DataFrame:
    """Accepted, inserted and duplicate events per batch."""
    accepted = df.groupBy("batch_id").agg(F.count("*").alias("accepted"))
    inserted = dedup_events(df, ["batch_id"]).groupBy("batch_id").agg(F.count("*").alias("inserted"))
    return (accepted.join(inserted, "batch_id", "left")
            .select("batch_id", "accepted", F.coalesce("inserted", F.lit(0)).alias("inserted"),
                    (F.col("accepted") - F.coalesce("inserted", F.lit(0))).alias("duplicates")))


def sequence_gaps(df: DataFrame) -> DataFrame:
    """Missing sequence ranges between the events of one producer."""
    seen = df.select("producer_id", "sequence").distinct()
    rows = previous(seen, ["producer_id"], ["sequence"], F.floor(F.col("sequence") / F.lit(float(SEQUENCE_SLICE))), {"before": "sequence"})
    return (rows.where("sequence > before + 1")
            .select("producer_id", (F.col("before") + 1).alias("gap_from"), (F.col("sequence") - 1).alias("gap_to"),
                    (F.col("sequence") - F.col("before") - 1).alias("missing")))


def time_regressions(df: DataFrame) -> DataFrame:
    """Events that happened before an earlier event, by sequence, of the same producer."""
    rows = df.select(packed(F.col("event_id")).alias("_id"), "producer_id", "sequence", "occurred_at")
    rows = running(rows, ["producer_id"], ["sequence", "event_id"], F.floor(F.col("sequence") / F.lit(float(SEQUENCE_SLICE))),
                   {"latest": ("max", F.col("occurred_at"))}, before=True, late={"event_id": unpacked(F.col("_id"))})
    return (rows.where("occurred_at < latest")
            .select("event_id", "producer_id", "sequence", "occurred_at", F.col("latest").alias("latest_before")))


def tag_priority(df: DataFrame) -> DataFrame:
    """Delivery class of an event: terminal and gateway events are critical, heartbeats low, usage updates normal."""
    kind, state = F.split_part("event_type", F.lit("."), F.lit(1)), F.split_part("event_type", F.lit("."), F.lit(2))
    usage = F.coalesce(F.try_variant_get(F.try_parse_json("payload"), "$.accountingUpdate", "boolean"), F.lit(False))
    return df.withColumn("priority", F.when(F.col("event_type") == "gateway.heartbeat", "low")
                         .when(usage, "normal").when(kind.isin("gateway", "monitor") | state.isin("completed", "failed"), "critical")
                         .otherwise("normal"))
