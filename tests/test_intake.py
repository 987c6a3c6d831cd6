import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import T0, event, rows
from spanlake.operators import diagnostics, validate
from spanlake.operators.merge import StateStore
from spanlake.operators.timeseries import timeseries_points
from spanlake.sources import events as src
from spanlake.streaming import ingest

NOW = "2026-07-10 09:00:00"


def wire(n, kind="agent.started", second=0, payload=None, **extra):
    return {"schemaVersion": 1, "eventId": f"{n:08d}-0000-4000-8000-{n:012d}", "eventType": kind, "occurredAt": f"2026-07-10T08:{second // 60:02d}:{second % 60:02d}.5Z",
            "instanceId": "i", "producerId": "p", "sequence": n, "source": "plugin", "payload": payload or {"runId": f"r{n}", "deep": {"a": [1, "x"]}}, **extra}


def put(folder, name, body):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body))


def test_event_files(spark, tmp_path):
    put(tmp_path / "in", "a.json", [wire(1), wire(2)])
    put(tmp_path / "in", "b.json", [wire(3), wire(4, kind="made.up")])
    put(tmp_path / "in", "c.json", "[]")
    put(tmp_path / "in", "d.json", "no json")
    put(tmp_path / "in", "e.json", [wire(n) for n in range(100, 1101)])
    put(tmp_path / "in", "f.json", " " * (1 << 20) + "[]")
    (tmp_path / "in" / "g.json").write_bytes(b"[\xff\xfe]")
    batches = src.read_batches(spark, str(tmp_path / "in")).withColumn("problem", src.batch_problem(NOW))
    got = {r.batch_id.rsplit("/", 1)[1]: r.problem for r in batches.collect()}
    assert got == {"a.json": None, "b.json": "bad_event", "c.json": "batch_events", "d.json": "batch_events", "e.json": "batch_events", "f.json": "batch_bytes", "g.json": "batch_events"}
    scans = [line for line in batches._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan binaryFile" in line]
    assert sum("content" in line.split("Batched")[0] and "LessThanOrEqual(length,1048576)" in line for line in scans) == 1
    assert sum("content" not in line.split("Batched")[0] and "GreaterThan(length,1048576)" in line for line in scans) == 1
    ok = src.accepted(src.read_batches(spark, str(tmp_path / "in")), NOW).orderBy("sequence").collect()
    assert [r.sequence for r in ok] == [1, 2]
    assert ok[0].occurred_at == datetime(2026, 7, 10, 8, 0, 0, 500000) and json.loads(ok[0].payload)["deep"] == {"a": [1, "x"]}


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"schema_version": 2}, "schema_version"), ({"event_id": "x" * 65}, "event_id"), ({"event_type": "made.up"}, "event_type"),
    ({"occurred_at": "2026-07-12 09:00:01"}, "occurred_at"), ({"instance_id": "a b"}, "identity"), ({"producer_id": ""}, "identity"), ({"source": "me"}, "source"),
    ({"process_id": 0}, "process_id"), ({"payload": "[1]"}, "payload"), ({"payload": '{"a":'}, "payload"), ({"payload": json.dumps({"a": "x" * 16384})}, "size"),
])
def test_validation_rules(ledger, change, reason):
    df = ledger([event(1, "agent.started", 0, {"runId": "r"})])
    for name, value in change.items():
        df = df.withColumn(name, F.lit(value).cast(df.schema[name].dataType))
    assert rows(validate.with_reason(df, NOW), "reason") == [(reason,)]


def test_a_bad_event_rejects_its_batch(ledger):
    df = ledger([event(1, "agent.started", 0, {}, batch="good"), event(2, "agent.started", 0, {}, batch="bad"), event(3, "made.up", 0, {}, batch="bad")])
    assert rows(validate.reject_bad_batches(df, NOW), "sequence") == [(1,)]


def test_contract(spark, tmp_path, ledger):
    put(tmp_path / "in", "a.json", [wire(1), wire(2, mine=1), wire(3, payload={"bad-key": 1}), wire(4, payload={"a": {"b": ["x" * 4097]}}), wire(5, payload={"a": list(range(129))})])
    got = validate.contract_check(src.read_envelope_texts(spark, str(tmp_path / "in")), "unknown_keys")
    assert sorted((int(r.event_id[:8]), r.rule) for r in got.collect()) == [(2, "unknown_key"), (3, "payload_key"), (4, "string_length"), (5, "array_length")]


def test_copies_of_one_event_shrink_before_the_shuffle(ledger):
    df = validate.dedup_events(ledger([event(1, "agent.started", 0, {})]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") >= 1


def test_diagnostics_never_carry_content(spark, tmp_path):
    lines = [{"type": "model.call.started", "ts": 1000, "seq": 1, "runId": "r", "callId": "c", "sessionKey": "agent:tom:1", "provider": "p", "model": "m", "prompt": "secret"},
             {"type": "model.usage", "ts": 2000, "seq": 2, "runId": "r", "lastCallUsage": {"input": 5, "output": 2}, "costUsd": 0.5, "response": "secret"},
             {"type": "model.usage", "ts": 3000, "seq": 3, "runId": "other", "usage": {"input": 9}},
             {"type": "tool.execution.blocked", "ts": 4000, "seq": 4, "toolSource": "mcp", "toolName": "a\nb"}, {"type": "unknown.kind", "ts": 1, "seq": 5}]
    put(tmp_path / "in", "a.json", "\n".join(json.dumps(x) for x in lines))
    raw = src.read_diagnostics(spark, str(tmp_path / "in"))
    mapped = diagnostics.map_diagnostics(raw)
    got = {r.event_type: r for r in mapped.collect()}
    assert set(got) == {"llm.started", "mcp.failed"}
    assert got["llm.started"].agent_id == "tom" and got["llm.started"].session_key_hash.startswith("sha256:") and len(got["llm.started"].session_key_hash) == 31
    assert (got["mcp.failed"].tool_call_id, got["mcp.failed"].tool_name, got["mcp.failed"].error_category) == ("event-4", "a b", "blocked")
    usage = {r.sequence: r for r in diagnostics.attribute_usage(raw).collect()}
    assert (usage[2].call_id, usage[2].provider, usage[2].input_tokens) == ("c", "p", 5) and usage[3].call_id is None
    out = diagnostics.to_envelopes(mapped, F.lit("i")).collect()
    assert all("secret" not in r.payload and "null" not in r.payload for r in out)
    assert json.loads([r for r in out if r.event_type == "mcp.failed"][0].payload)["toolName"] == "a b"


def test_prices(spark, tmp_path):
    put(tmp_path / "in", "p.json", {"data": [{"id": "qwen/Qwen3-Max", "pricing": {"prompt": "0.5", "completion": "1"}}, {"id": "x", "pricing": {"prompt": "1", "completion": "1"}},
                                             {"id": "a/free", "pricing": {"prompt": "0", "completion": "0"}}, {"id": "a/bad", "pricing": {"prompt": "no", "completion": "0"}}]})
    got = {r.price_key: (float(r.input_price), float(r.output_price)) for r in src.read_pricing(spark, str(tmp_path / "in")).collect()}
    assert got["bailian|qwen3-max"] == (0.5, 1.0) and len(got) == 7 and "a|free" not in got


def test_stream_equals_batch(spark, tmp_path, tables):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    put(folder, "1.json", [wire(1), wire(2, "llm.started", 5, {"callId": "c", "runId": "r1"})])
    put(folder, "2.json", [wire(9, "made.up"), wire(3)])
    ingest.start_ingest(src.stream_batches(spark, str(folder)), root, str(tmp_path / "cp"), NOW).awaitTermination()
    put(folder, "3.json", [wire(1), wire(3, "agent.completed", 30, {"runId": "r1", "durationMs": 5}), wire(4, "llm.completed", 20, {"callId": "c", "runId": "r1", "inputTokens": 7})])
    ingest.start_ingest(src.stream_batches(spark, str(folder)), root, str(tmp_path / "cp"), NOW).awaitTermination()
    t = StateStore(spark, root).tables()
    assert sorted(r.sequence for r in t.ledger.collect()) == [1, 2, 3, 4]
    assert rows(t.agent_runs, "run_id", "status", "duration_ms") == [("r1", "completed", 5.0)]
    assert rows(t.llm_calls, "call_id", "status", "input_tokens") == [("c", "completed", 7)]


def test_live_views(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "1.json", [wire(1), wire(2, "llm.started", 70, {"callId": "c", "runId": "r1"}), wire(3, "agent.completed", 80, {"runId": "r1"}), wire(4, "agent.started", 90, {"runId": "r1"}),
                           wire(5, "gateway.heartbeat", 91, {"queueDepth": 81, "queueCapacity": 100}), wire(6, "gateway.heartbeat", 92, {"queueDepth": 10, "queueCapacity": 100})])
    put(folder, "2.json", [wire(1)])

    def collect(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    unique = lambda: ingest.unique_events(src.stream_batches(spark, str(folder)), NOW)
    raw = lambda: src.accepted(src.stream_batches(spark, str(folder)), NOW)
    assert {(r.instance_id, r.kind, r.id, r.status) for r in collect(ingest.stream_lifecycle(unique()), "life", "update")} >= {("i", "agent", "r1", "completed"), ("i", "llm", "c", "active")}
    assert [(r.event_id[:8], r.edge) for r in collect(ingest.stream_backpressure(unique()), "edges", "update")] == [("00000005", "saturated"), ("00000006", "recovered")]
    series = {r.time: (r.runs, r.llmRequests) for r in collect(ingest.stream_timeseries(raw(), "1m"), "series", "update")}
    assert series[datetime(2026, 7, 10, 8, 1)] == (1, 1)
    ingest.live_tail(unique(), str(tmp_path / "tail"), str(tmp_path / "tail_cp")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "tail")).select("sequence").collect())[0][0] == 1
    assert spark.read.parquet(str(tmp_path / "tail")).count() == 6


def test_counts_of_a_stream(spark, tmp_path):
    put(tmp_path / "in", "1.json", [wire(1), wire(2, second=20), wire(3, "llm.started", 70, {"callId": "c"})])
    events = ingest.unique_events(src.stream_batches(spark, str(tmp_path / "in")), NOW)
    raw = src.accepted(src.stream_batches(spark, str(tmp_path / "in")), NOW)
    batches = []

    def collect(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {(r.event_type, r.events) for r in collect(ingest.event_pulse(raw), "pulse", "complete")} == {("agent.started", 2), ("llm.started", 1)}
    sliding = {(r.at, r.event_type): (r.events, r.rate) for r in collect(ingest.sliding_counts(raw, "1 minute", "30 seconds"), "sliding", "complete")}
    minute = lambda s: datetime(2026, 7, 10, 8, s // 60, s % 60)
    assert sliding == {(minute(30), "agent.started"): (2, 2 / 60), (minute(60), "agent.started"): (2, 2 / 60), (minute(90), "llm.started"): (1, 1 / 60), (minute(120), "llm.started"): (1, 1 / 60)}
    q = ingest.start_refresh(events, lambda batch, n: batches.append((n, batch.count())), str(tmp_path / "refresh"))
    q.processAllAvailable()
    q.stop()
    assert batches[0] == (0, 3)


def test_write_and_read_back(spark, tmp_path, ledger):
    src.write_ledger(ledger([event(1, "agent.started", 0, {}), event(2, "agent.started", -86400, {})]), str(tmp_path / "ledger"))
    back = src.read_ledger(spark, str(tmp_path / "ledger"))
    assert sorted(str(r.event_date) for r in back.collect()) == ["2026-07-09", "2026-07-10"]


def test_deep_payloads_are_looked_through(spark):
    nest = lambda depth, inner: '{"a":' + "[" * depth + inner + "]" * depth + "}"
    df = spark.createDataFrame([("fine", 0, nest(480, "1")), ("long", 0, nest(480, '"' + "x" * 4097 + '"'))], "event_id string, sequence bigint, payload string")
    assert [tuple(r) for r in validate.contract_check(df).collect()] == [("long", "string_length")]
