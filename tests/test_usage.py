import random
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import T0
from spanlake.functions.ordered import volume_slices
from spanlake.operators import usage as U

EVENTS = ("instance_id string, call_id string, received_at timestamp, producer_id string, sequence bigint, event_id string, run_id string, provider string, model string, "
          "start timestamp, end timestamp")
RECORDS = "instance_id string, received_at timestamp, producer_id string, sequence bigint, event_id string, run_id string, provider string, model string, raise struct<tokens:bigint>"


def scenario(n, runs, seed=1, span=400):
    """Events of calls that change run, provider, model and time, and records, at times that often tie."""
    rng = random.Random(seed)
    events, records = [], []
    for i in range(n):
        at = (T0 + timedelta(seconds=rng.randrange(span)), rng.choice("pq"), rng.randrange(3), f"e{i:06d}")
        if rng.random() < 0.4:
            records.append(("i", *at, f"r{rng.randrange(runs)}", rng.choice(["", "", "x", "y"]), rng.choice(["", "", "m"]), (i,)))
        else:
            time = lambda: rng.choice([None, T0 + timedelta(seconds=rng.randrange(50))])
            events.append(("i", f"c{rng.randrange(max(2, n // 6))}", *at, rng.choice([None, "", f"r{rng.randrange(runs)}"]), rng.choice([None, "", "x", "y"]), rng.choice([None, "m", "k"]), time(), time()))
    return events, records


def plain_matches(events, records):
    out, state = set(), {}
    for at, row in sorted([(e[2:6], e) for e in events] + [(r[1:5], r) for r in records], key=lambda x: x[0]):
        if len(row) == 11:
            s = state.setdefault(row[1], [None, "", "", None, None])
            s[0], s[1], s[2], s[3], s[4] = row[6] or s[0], row[7] or s[1], row[8] or s[2], s[3] or row[9], row[10] or s[4]
        else:
            fits = [((s[4] or s[3] or T0 - timedelta(days=1)), c) for c, s in state.items() if s[0] == row[5] and row[6] in ("", s[1]) and row[7] in ("", s[2])]
            if fits:
                out.add((row[4], row[5], max(fits)[1], row[8][0]))
    return out


@pytest.mark.parametrize("n, runs, largest", [(300, 12, 1 << 18), (400, 2, 40), (400, 1, 7)])
def test_matches_as_plain_replay(spark, n, runs, largest):
    events, records = scenario(n, runs)
    got = U.newest_calls(spark.createDataFrame(events, EVENTS), spark.createDataFrame(records, RECORDS), largest).collect()
    want = plain_matches(events, records)
    assert {(r.event_id, r.run_id, r.call_id, r["raise"].tokens) for r in got} == want and len(got) == len(want) > n // 10


def test_run_of_100_000_records(spark):
    """Half of the calls move to another run later, so the newest call of a moment is not the newest of all."""
    n = 100_000
    base = spark.range(n)
    at = (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") / 50))
    key = [F.lit("p").alias("producer_id"), F.col("id").alias("sequence")]
    call = F.concat(F.lit("c"), F.lpad(F.floor(F.col("id") / 4).cast("string"), 6, "0"))
    events = base.where("id % 4 in (0, 2)").select(F.lit("i").alias("instance_id"), call.alias("call_id"), at.alias("received_at"), *key, F.concat(F.lit("e"), "id").alias("event_id"),
                                                   F.when(F.col("id") % 4 == 0, "r").otherwise(F.when(F.col("id") % 8 == 2, "other")).alias("run_id"), F.lit("x").alias("provider"), F.lit("").alias("model"),
                                                   at.alias("start"), F.lit(None).cast("timestamp").alias("end"))
    records = base.select(F.lit("i").alias("instance_id"), at.alias("received_at"), F.lit("q").alias("producer_id"), F.col("id").alias("sequence"), F.concat(F.lit("u"), "id").alias("event_id"),
                          F.lit("r").alias("run_id"), F.lit("").alias("provider"), F.lit("").alias("model"), F.struct(F.col("id").alias("tokens")).alias("raise"))
    got = {r["raise"].tokens: r.call_id for r in U.newest_calls(events, records, largest=5000).collect()}
    want, here = {}, []
    for i in range(n):
        if i % 4 == 0:
            here.append(i // 4)
        if i % 8 == 2:
            here.remove(i // 4)
        want[i] = f"c{here[-1]:06d}" if here else None
    assert got == {i: c for i, c in want.items() if c}


def test_slices_by_volume(spark):
    rows = spark.range(10_000).select(F.lit("k").alias("k"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.when(F.col("id") < 9000, F.col("id") / 10).otherwise(F.col("id") * 100))).alias("t"))
    sizes = [r["count"] for r in volume_slices(rows, ["k"], "t", 500, "cut").groupBy("cut").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 510  # nine tenths of the rows lie in a quarter of an hour


def test_small_runs_of_a_chunk_share_the_reading_of_columns(monkeypatch):
    """A chunk of 500 runs, each a call and a record, turns every column into a list once."""
    rows = pd.DataFrame([{"kind": kind, "instance_id": "i", "home": f"r{i}", "call_id": f"c{i}" if kind == U.EVENT else None, "event_id": f"e{i}", "run_id": f"r{i}", "provider": "", "model": "",
                          "start": 1, "end": U.NEVER, "raise": "{}", "cut": 0} for i in range(500) for kind in (U.EVENT, U.RECORD)])
    lists, plain = [], pd.Series.tolist
    monkeypatch.setattr(pd.Series, "tolist", lambda self: lists.append(self.name) or plain(self))
    found = pd.concat(U._matched(iter([rows])))
    assert found["call_id"].tolist() == [f"c{i}" for i in range(500)] and found["home"].tolist() == [f"r{i}" for i in range(500)]
    assert len(lists) < 20
