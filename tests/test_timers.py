import random
import time
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import T0, event
from spanlake.operators.alerts import staleness
from spanlake.operators.counters import counter_increase
from spanlake.operators.reduce import reduce_instances
from spanlake.streaming import timers
from spanlake.tables import Tables


class Handle:
    """State and timers of one key, with a clock the test moves."""

    def __init__(self):
        self.value, self.timers, self.now = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        assert at > self.now
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def millis(at):
    return round(at.replace(tzinfo=timezone.utc).timestamp() * 1000)


def drain(stream, path, mode):
    q = stream.writeStream.format("memory").queryName(path.name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(path.name).collect()


def test_silence_by_a_moved_clock_equals_the_batch_operator(spark, ledger):
    draw = random.Random(3)
    kinds = ["gateway.started", "gateway.heartbeat", "gateway.heartbeat", "resource.sampled", "resource.sampled", "gateway.stopped", "gateway.crashed", "agent.started"]
    events, second = [], 0
    for n in range(1, 61):
        second += draw.choice([5, 60, 250, 700])
        events.append(event(n, draw.choice(kinds), second - draw.choice([0, 0, 30, 400]), {}, arrival=second, instance=draw.choice(["i", "j", "k"])))
    clocks = sorted(draw.sample(range(second + 2000), 4)) + [second + 300, second + 4000]
    processors, severity = {}, {}

    def wake(until):
        while due := [(at, key) for key, (_, h) in processors.items() for at in h.timers if at <= until]:
            at, key = min(due)
            p, h = processors[key]
            h.timers.remove(at)
            h.now = at
            for out in p.handleExpiredTimer(key, h, None):
                severity[key] = out["severity"][0]

    def feed(batch, now):
        pdf = pd.DataFrame([("instance", e[4], e[2].split(".")[1] if e[2].startswith(("gateway", "resource")) else "other", 1000 * millis(e[10]), e[5], e[7], e[1], 1000 * millis(e[3])) for e in batch],
                           columns=[part.split()[0] for part in timers.SIGNS.split(", ")])
        halves = [pdf.iloc[::2], pdf.iloc[1::2]]  # two Arrow batches whose rows interleave
        for key, part in pd.concat(list(timers._signs(iter(halves)))).groupby(["subject", "id"]):
            if key not in processors:
                h = Handle()
                processors[key] = (timers.Silence(timers.SILENCE), h)
                processors[key][0].init(h)
            p, h = processors[key]
            h.now = now
            for out in p.handleInputRows(key, iter([part]), h):
                severity[key] = out["severity"][0]

    at = 0
    for clock in clocks:
        now = T0 + timedelta(seconds=clock)
        wake(millis(now))
        fresh = [e for e in events[at:] if e[10] <= now]
        if fresh:
            feed(fresh, millis(now))
        at += len(fresh)
        seen = ledger(events[:at]) if at else None
        if seen is not None:
            want = {(r.subject, r.id): r.severity for r in staleness(Tables(spark, {"ledger": seen, "instances": reduce_instances(seen)}), str(now)).collect()}
            assert {k: v for k, v in severity.items() if v} == {k: v for k, v in want.items() if v}
    assert at == len(events) and any(severity.values())


def test_silence_in_a_stream(spark, ledger, tmp_path):
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    ago = lambda minutes: (now - timedelta(minutes=minutes) - T0).total_seconds()
    beat = lambda n, minutes, instance, kind="gateway.heartbeat": event(n, kind, ago(minutes), {}, arrival=ago(minutes), instance=instance)
    ledger([beat(1, 40, "old"), beat(2, 8, "quiet"), beat(3, -30, "busy"), beat(4, 50, "down"), beat(5, 45, "down", "gateway.stopped")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = (timers.stream_staleness(stream).writeStream.format("memory").queryName("silence").outputMode("update").option("checkpointLocation", str(tmp_path / "silence"))
         .trigger(processingTime="1 second").start())
    try:
        until = time.monotonic() + 120
        while q.lastProgress is None and q.isActive and time.monotonic() < until:
            time.sleep(0.5)
        got = {(r.subject, r.id): (r.severity, r.lastAt) for r in spark.table("silence").collect()}
    finally:
        q.stop()
    assert {k: v[0] for k, v in got.items() if v[0]} == {("instance", "old"): "critical", ("instance", "quiet"): "warning"}
    assert got[("instance", "quiet")][1] == now - timedelta(minutes=8)


@pytest.mark.parametrize("by", [None, ["status"]])
def test_increases_in_a_stream_equal_the_batch_operator(spark, tmp_path, by):
    draw, rows = random.Random(7), []
    for series in range(3):
        value = 0.0
        for second in range(0, 400, 10):
            value = draw.choice([0.0, 1.0]) if draw.random() < 0.1 else value + draw.randrange(4)
            rows.append(("calls", f"s{series}", "failed" if series else "ok", T0 + timedelta(seconds=second + draw.random() * 3), value, second + draw.choice([0, 0, 8])))
    rows.sort(key=lambda r: r[5])  # a little out of order
    ends = [[("end", "", "", T0 + timedelta(days=d), 0.0, 0)] for d in (1, 2)]
    schema = "metric string, name string, status string, ts timestamp, value double, turn int"
    for n, part in enumerate([rows[:50], rows[50:90], rows[90:], *ends]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = "rises_by_status" if by else "rises"
    got = {(r.at, *[r[c] for c in by or ["name", "status"]]): r.increase
           for r in drain(timers.stream_counter_increase(stream, ["name", "status"], 60, 15, by, late="30 seconds"), tmp_path / name, "append")}
    batch = counter_increase(spark.createDataFrame(rows, schema).drop("turn"), ["name", "status"], 60, 15, by)
    want = {(r.at, *[r[c] for c in by or ["name", "status"]]): r.increase for r in batch.collect()}
    assert want and got == pytest.approx(want)
