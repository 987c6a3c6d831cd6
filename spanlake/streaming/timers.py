"""Views of a stream that time itself changes: instances gone silent, and increases of counters over sliding windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import ARRIVAL

LATE = "24 hours"
STREAM = "event-stream"
#: Minutes of silence before a warning and before it becomes critical.
SILENCE = {"stream": (10.0, 30.0), "instance": (5.0, 15.0)}
SIGNS = "subject string, id string, kind string, received_at bigint, producer_id string, sequence bigint, event_id string, seen bigint"
TURNS = ("started", "stopped", "crashed")


def _signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per Arrow batch the rows that can still decide: every turn, the first and last heartbeat of an instance, the samples
    that no later one of the instance exceeds, and one row for the stream.  A busy instance thus sends few rows on."""
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf.sort_values(list(ARRIVAL), kind="stable")
        newest = pdf.iloc[[-1]].assign(subject="stream", id=STREAM, kind="event")
        newest["seen"] = newest["received_at"]
        beats = pdf[pdf["kind"] == "heartbeat"]
        samples = pdf[pdf["kind"] == "sampled"].iloc[::-1]
        later = samples.groupby("id")["seen"].cummax().groupby(samples["id"]).shift()
        yield pd.concat([newest, pdf[pdf["kind"].isin(TURNS)], beats.drop_duplicates("id"), beats.drop_duplicates("id", keep="last"),
                         samples[later.isna() | (samples["seen"] > later)]])[list(pdf.columns)]


class Silence(StatefulProcessor):
    """Keeps when a subject was last seen; a timer wakes it when its silence reaches the next limit."""

    def __init__(self, limits: dict[str, tuple[float, float]]):
        self._limits = {subject: [round(minutes * 60000) for minutes in both] for subject, both in limits.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "status string, since bigint, seen bigint, severity string, timer bigint")

    def _judged(self, key, status, since, seen, severity, timer, now: int):
        """Stores the subject as it stands at ``now`` and returns its row if the severity is another one."""
        if timer is not None:
            self._handle.deleteTimer(timer)
        age = now - seen // 1000
        limits = self._limits[key[0]] if status == "up" else []
        ahead = [limit for limit in limits if limit > age]
        level = ["critical", "warning", ""][len(ahead)] if limits else ""
        timer = seen // 1000 + ahead[0] if ahead else None
        if timer is not None:
            self._handle.registerTimer(timer)
        self._held.update((status, since, seen, level, timer))
        if level != severity:
            yield pd.DataFrame({"subject": [key[0]], "id": [key[1]], "lastAt": pd.to_datetime([seen], unit="us", utc=True), "severity": [level]})

    def handleInputRows(self, key, rows, timerValues):
        status, since, seen, severity, timer = self._held.get() if self._held.exists() else (None,) * 5
        signs = pd.concat(list(rows)).sort_values(list(ARRIVAL), kind="stable")
        for kind, at in zip(signs["kind"], signs["seen"].tolist()):
            if kind in ("started", "heartbeat"):
                status, since, seen = "up", at if kind == "started" else since, at
            elif kind == "event":
                status, seen = "up", max(at, seen or at)
            elif status is None:  # nothing counts before the first start or heartbeat
                if kind == "started":
                    since = at
            elif kind == "sampled":
                seen = max(at, seen)
            elif since is None or since <= at:
                status, seen = kind, at
        if status is not None:
            yield from self._judged(key, status, since, seen, severity, timer, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        *held, _ = self._held.get()  # the timer that woke it is gone already
        yield from self._judged(key, *held, None, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def stream_staleness(events: DataFrame, limits: dict[str, tuple[float, float]] = SILENCE) -> DataFrame:
    """(subject, id, lastAt, severity) whenever the severity of the stream or an instance changes (update mode).

    The rules are those of the batch operator: an instance that is not up is never stale.  Micro-batches must come in order
    of arrival; inside one, any order gives the same rows.  Only the processing clock ages a subject, so rows also come
    while no event arrives, and the query never ends by itself: give it a trigger by interval, not ``availableNow``.  Needs
    the RocksDB state store provider.
    """
    family = F.split_part("event_type", F.lit("."), F.lit(1))
    sign = F.when(family.isin("gateway", "resource"), F.split_part("event_type", F.lit("."), F.lit(2))).otherwise(F.lit("other"))
    rows = events.select(F.lit("instance").alias("subject"), F.col("instance_id").alias("id"), sign.alias("kind"), F.unix_micros("received_at").alias("received_at"),
                         "producer_id", "sequence", "event_id", F.unix_micros("occurred_at").alias("seen"))
    return rows.mapInPandas(_signs, SIGNS).groupBy("subject", "id").transformWithStateInPandas(
        Silence(limits), "subject string, id string, lastAt timestamp, severity string", "Update", "ProcessingTime")


class Increase(StatefulProcessor):
    """Holds the samples of one series until the watermark has passed them, then takes increases in order of time."""

    def __init__(self, names: list[str], step: int):
        self._names, self._step = names, step * 1000000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "value double")
        self._waiting = handle.getListState("waiting", "at bigint, value double")

    def _wake(self, samples: list) -> None:
        self._handle.registerTimer(-(-min(samples)[0] // 1000))

    def handleInputRows(self, key, rows, timerValues):
        samples = [pair for pdf in rows for pair in zip(pdf["us"].tolist(), pdf["value"].tolist())]
        self._waiting.appendList(samples)
        self._wake(samples)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        samples = sorted((int(at), float(value)) for at, value in self._waiting.get())
        due = [s for s in samples if s[0] <= passed]
        if not due:  # an earlier timer of the same micro-batch took them
            return
        rest = samples[len(due):]
        self._waiting.put(rest) if rest else self._waiting.clear()
        if rest:
            self._wake(rest)
        before, steps = self._last.get()[0] if self._last.exists() else None, {}
        for at, value in due:
            if before is not None:
                instant = -(-at // self._step) * self._step
                steps[instant] = steps.get(instant, 0.0) + (value if value < before else value - before)
            before = value
        self._last.update((before,))
        if steps:
            # a microsecond early, since an increase belongs to the windows that end at its instant or later
            yield pd.DataFrame({**{name: [part] * len(steps) for name, part in zip(self._names, key)},
                                "at": pd.to_datetime([instant - 1 for instant in steps], unit="us", utc=True), "increase": list(steps.values())})

    def close(self) -> None:
        pass


def stream_counter_increase(samples: DataFrame, labels: list[str], look_back: int, step: int, by: list[str] | None = None, late: str = LATE) -> DataFrame:
    """Increase over the look-back at every instant, summed by the given labels, once the instant is closed (append mode).

    Equal to the batch operator on closed instants.  A series holds in state its last value and the samples of the time
    rows may be late by; samples later than that are left to the batch operator.  Needs the RocksDB provider.
    """
    if look_back % step:
        raise ValueError("the look-back must be a multiple of the step")
    by, keys = labels if by is None else by, ["metric", *labels]
    rows = samples.where("ts is not null and value is not null").withWatermark("ts", late).select(*keys, "ts", F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    steps = rows.groupBy(*keys).transformWithStateInPandas(Increase(keys, step), f"{kinds}, at timestamp, increase double", "Append", "EventTime", eventTimeColumnName="at")
    return (steps.groupBy("metric", *by, F.window("at", f"{look_back} seconds", f"{step} seconds").alias("w")).agg(F.sum("increase").alias("increase"))
            .select("metric", *by, F.col("w.end").alias("at"), "increase"))


def stream_counter_rate(samples: DataFrame, labels: list[str], look_back: int, step: int, by: list[str] | None = None, late: str = LATE) -> DataFrame:
    out = stream_counter_increase(samples, labels, look_back, step, by, late)
    return out.withColumn("rate", F.col("increase") / F.lit(float(look_back))).drop("increase")
