from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import T0, event, rows
from spanlake.functions.ordered import previous, running, time_slice
from spanlake.functions.quantiles import NEAREST, rank_quantiles
from spanlake.operators import alerts, charts, counters, lists, pricing, stats, summary, trace
from spanlake.operators.charts import ChartSpec
from spanlake.operators.counters import HoldRule
from spanlake.operators.dashboard import dashboard
from spanlake.operators.filters import Filters


def test_rank_quantiles_against_sorting(spark):
    import math
    import random
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.choice([None, 0.0, float(rng.randrange(50)), rng.random() * 1e6])) for _ in range(700)]
    df = spark.createDataFrame(data, "k string, v double")
    qs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    low = {r.k: r for r in rank_quantiles(df, ["k"], "v", qs).collect()}
    near = {r.k: r for r in rank_quantiles(df, ["k"], "v", qs, NEAREST).collect()}
    for k in "ab":
        order = sorted((v for g, v in data if g == k), key=lambda v: (v or 0.0, v is not None))
        for name, q in qs.items():
            assert low[k][name] == order[int((len(order) - 1) * q)]
            assert near[k][name] == order[max(1, math.ceil(len(order) * q)) - 1]


@pytest.mark.parametrize("value", ["1e9 + rand(4) * 1e-3", "1e5 * pow(rand(5), 40)", "2 + cast(rand(6) * 3 as int) * 4.440892098500626e-16", "5 - exp(rand(7) * 400)"])
def test_rank_quantiles_of_a_million_values(spark, value):
    from spanlake.functions.lineage import written
    df = written(spark.range(1_000_000).select(F.lit("k").alias("k"), F.when(F.col("id") % 50 > 0, F.expr(value)).alias("v")))
    order = sorted((x.v for x in df.collect()), key=lambda v: (v or 0.0, v is not None))
    got = rank_quantiles(df, ["k"], "v", {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()[0]
    assert [got[f"p{q}"] for q in (1, 50, 95, 99)] == [order[int((len(order) - 1) * q / 100)] for q in (1, 50, 95, 99)]


def test_running_values_against_a_plain_window(spark):
    from pyspark.sql import Window as W
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.lit("2026-01-01").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, id * 97.5)")).alias("t"), "id",
                                 F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    got = running(df, ["k"], ["t", "id"], time_slice("t"), {"s": ("sum", F.col("id")), "l": ("last", F.col("v")), "m": ("max", F.col("v"))})
    got = previous(got, ["k"], ["t", "id"], time_slice("t"), {"b": "id"})
    got = previous(got, ["k"], ["t", "id"], time_slice("t"), {"n": "id"}, backwards=True)
    w = W.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.sum("id").over(w).alias("s"), F.last("v", True).over(w).alias("l"), F.max("v").over(w).alias("m"), F.lag("id").over(w).alias("b"), F.lead("id").over(w).alias("n"))
    cols = ["id", "s", "l", "m", "b", "n"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


TRACE = [
    event(1, "session.started", 0, {"sessionId": "s"}),
    event(2, "agent.started", 0, {"runId": "root", "sessionId": "s", "spanId": "root"}), event(3, "agent.completed", 2, {"runId": "root", "sessionId": "s", "durationMs": 100}),
    event(4, "llm.completed", 1, {"callId": "llm", "runId": "root", "sessionId": "s", "spanId": "llm", "parentSpanId": "root", "durationMs": 800, "inputTokens": 100, "outputTokens": 20, "costUsd": 0.04}),
    event(5, "tool.completed", 1, {"toolCallId": "child", "runId": "root", "sessionId": "s", "spanId": "child", "parentSpanId": "llm", "durationMs": 250}),
    event(6, "tool.completed", 1, {"toolCallId": "other", "runId": "root", "sessionId": "s", "spanId": "other", "parentSpanId": "root", "durationMs": 500}),
    event(7, "tool.completed", 1, {"toolCallId": "loop", "runId": "gone", "sessionId": "s2", "spanId": "loop", "parentSpanId": "pool", "durationMs": 5}),
    event(8, "tool.completed", 1, {"toolCallId": "pool", "runId": "gone", "sessionId": "s2", "spanId": "pool", "parentSpanId": "loop", "durationMs": 5}),
    event(9, "tool.failed", 1, {"toolCallId": "lost", "runId": "gone", "sessionId": "s2", "durationMs": 7}),
    event(10, "llm.retried", 1, {"runId": "root", "sessionId": "s", "toModel": "m2"}),
]


def test_critical_path(tables):
    t = tables(TRACE)
    got = trace.critical_path(t).collect()
    assert {(r.session_id, r.span_id, r.critical_duration_ms) for r in got} == {("s", "root", 1150.0), ("s", "llm", 1150.0), ("s", "child", 1150.0),
                                                                                  ("s2", "unlinked", 14.0), ("s2", "lost", 14.0)}
    s = {r.session_id: r for r in trace.trace_summary(t).collect()}["s"]
    assert (s.llmCalls, s.toolCalls, s.totalTokens, s.costUsd, s.retries) == (1, 2, 120, 0.04, 1)
    run = lists.run_detail(t, ("local-test", "root")).collect()[0]
    assert [c.toolCallId for c in run.toolCalls] == ["child", "other"] and run.llmCalls[0].callId == "llm" and run.mcpCalls is None


def test_deep_trace(tables):
    events = [event(1, "agent.completed", 0, {"runId": "r", "sessionId": "s", "durationMs": 1})]
    events += [event(i + 2, "tool.completed", 1, {"toolCallId": f"t{i}", "runId": "r", "sessionId": "s", "spanId": f"t{i}", "parentSpanId": f"t{i - 1}" if i else "r", "durationMs": 1}) for i in range(21)]
    got = trace.critical_path(tables(events)).collect()
    assert len(got) == 22 and {r.critical_duration_ms for r in got} == {22.0}


def chains(n, sessions=3):
    """Forests of ``n`` spans with random parents, loops, repeated span ids and spans of other runs."""
    import random
    rng = random.Random(n)
    out = [event(s + 1, "agent.completed", 0, {"runId": f"r{s}", "sessionId": f"s{s % sessions}", "durationMs": 3, **({"spanId": "shared"} if s % 2 else {})}) for s in range(2 * sessions)]
    for i in range(n):
        parent = rng.choice(["", f"p{rng.randrange(n)}", f"p{rng.randrange(i + 1)}", "shared", "r0"])
        out.append(event(i + 100, rng.choice(["tool.completed", "llm.completed"]), rng.randrange(50), {
            "toolCallId": f"c{i}", "callId": f"c{i}", "runId": rng.choice(["gone", f"r{rng.randrange(2 * sessions)}"]), "sessionId": f"s{rng.randrange(sessions)}",
            "spanId": f"p{rng.randrange(n) if i % 5 == 0 else i}", "parentSpanId": parent, "durationMs": rng.randrange(6)}))
    return out


def stored(t):
    """The same tables, written."""
    from spanlake.functions.lineage import written
    from spanlake.tables import PROJECTIONS, Tables
    return Tables(t.spark, {name: written(t.get(name)) for name in PROJECTIONS})


def test_one_pass_and_doubling_agree(tables):
    t = stored(tables(chains(120)))
    by_pass = sorted(map(tuple, trace.critical_path(t).collect()))
    assert sorted(map(tuple, trace.critical_path(t, largest=45).collect())) == by_pass and by_pass  # one of three sessions is larger


def test_trace_of_100_000_spans_in_one_pass(spark):
    import numpy as np
    import pandas as pd
    n = 100_000
    name = np.array([f"p{i}" for i in range(n)])
    one = pd.DataFrame({"instance_id": "i", "session_id": "a", "kind": ["run", *["tool"] * (n - 1)], "id": name, "span_id": name, "parent": ["", *name[:-1]], "run_id": "p0", "began": 0, "duration_ms": 1.0})
    two = one.head(3).assign(session_id="b", duration_ms=[0.0, 5.0, 2.0])
    rows = pd.concat([one, two], ignore_index=True)
    parts = list(trace._each_session(rows.iloc[k:k + 7000] for k in range(0, len(rows), 7000)))
    out = pd.concat(parts)
    assert len(out) == n + 3 and set(out[out.session_id == "a"].critical_duration_ms) == {float(n)} and set(out[out.session_id == "b"].critical_duration_ms) == {7.0}


def test_critical_path_joins_no_spans_and_leaves_no_table(spark, tables):
    import os
    from spanlake.functions.lineage import application_folder
    t = stored(tables(TRACE))
    folder = application_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = trace.critical_path(t)
    assert set(os.listdir(folder)) == before
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2  # calls and subagents with their runs, for a parent of their own


def test_session_percentiles(tables):
    events = []
    for i, seconds in enumerate((1, 2, 10)):
        events += [event(2 * i + 1, "session.started", 0, {"sessionId": f"s{i}"}), event(2 * i + 2, "session.completed", seconds, {"sessionId": f"s{i}", "messageCount": 2})]
    r = summary.session_summary(tables(events), "2026-07-10 09:00:00").collect()[0]
    assert (r.total, r.active, r.messages, r.p50, r.p90, r.p99) == (3, 0, 6, 2000.0, 10000.0, 10000.0)


def frame(spark, data, kinds):
    return spark.createDataFrame(data, kinds).withColumn("time", F.col("time").cast("timestamp"))


def test_series_pivot(spark):
    df = frame(spark, [("2026-01-01 00:00:00", "p", "a", 10), ("2026-01-02 00:00:00", "p", "a", 30), ("2026-01-01 00:00:00", "p", "b", 20)], "time string, provider string, model string, inputTokens long")
    s = charts.series_of(df, ChartSpec("models", ("time", "model"), "inputTokens"))
    got = {}
    for r in s.orderBy("seriesRank", "categoryRank").collect():
        got.setdefault(r.series, []).append(r.value)
    assert got == {"a": [10.0, 30.0], "b": [20.0, 0.0]}
    assert [r.value for r in charts.cumulative(s).where("series = 'a'").orderBy("categoryRank").collect()] == [10.0, 40.0]
    assert [(r.stepStart, r.stepEnd) for r in charts.waterfall_steps(s).orderBy("categoryRank").collect()] == [(0.0, 30.0), (30.0, 60.0)]
    assert [r["count"] for r in charts.histogram(s).orderBy("bin").collect()] == [1, 1, 1, 1]
    assert charts.gauge(s).collect()[0].level == "critical"
    with pytest.raises(ValueError):
        charts.series_of(df, ChartSpec("models", ("color",), "inputTokens"))


def test_time_axis_keeps_the_first_or_last_categories(spark):
    df = frame(spark, [(f"2026-01-{d:02d} 00:00:00", d) for d in range(1, 21)], "time string, runs long")
    first = charts.series_of(df, ChartSpec("overview", ("time",), "runs")).orderBy("categoryRank").collect()
    last = charts.series_of(df, ChartSpec("overview", ("time",), "runs", tail=True)).orderBy("categoryRank").collect()
    assert [r.value for r in first] == [float(d) for d in range(1, 13)] and [r.value for r in last] == [float(d) for d in range(9, 21)]


def test_bubble_radius(spark):
    df = spark.createDataFrame([("c", "s", 3.0, 4.0, 100.0), ("d", "s", 1.0, 0.0, 0.0), ("e", "s", 0.0, 0.0, 9.0)], "category string, series string, value double, secondary double, size double")
    assert sorted(rows(charts.points(df, True), "x", "y", "r")) == [(1.0, 0.0, 4.0), (3.0, 4.0, 14.0)]


def test_alerts(tables):
    events = [event(100, "gateway.started", 0, {}), event(101, "gateway.crashed", 10, {}), event(1, "session.started", 0, {"sessionId": "stuck"})]
    for i in range(4):
        events.append(event(10 + i, "agent.failed" if i else "agent.completed", i, {"runId": f"r{i}", "agentId": "tom"}))
        events.append(event(20 + i, "tool.completed", i, {"toolCallId": f"t{i}", "toolName": "slow", "durationMs": 6000}))
    t = tables(events)
    got = alerts.evaluate_alerts(t, "2026-07-10 10:30:00", bucket="1m")
    by_id = {r.id: r.severity for r in got.collect()}
    assert by_id["agent-error:tom"] == "critical" and by_id["tool-latency:tool:slow"] == "warning" and by_id["session-stuck:local-test:stuck"] == "critical"
    assert by_id["instance:down:local-test"] == "critical" and by_id["stream:event-stale"] == "critical" and sum(k.startswith("system:") for k in by_id) == 1
    assert [r.severity for r in got.collect()] == sorted(by_id.values())
    state = t.spark.createDataFrame([("agent-error:tom", True, None), ("stream:event-stale", False, datetime(2027, 1, 1))], "id string, acknowledged boolean, silenced_until timestamp")
    flags = {r.id: (r.acknowledged, r.silenced) for r in alerts.apply_alert_state(got, state, "2026-07-10 10:30:00").collect()}
    assert flags["agent-error:tom"] == (True, False) and flags["stream:event-stale"] == (False, True) and flags["session-stuck:local-test:stuck"] == (False, False)


def test_counter_reset_and_hold(spark):
    def samples(values, metric="m"):
        return spark.createDataFrame([(T0 + timedelta(minutes=i), metric, "i", "", float(v)) for i, v in enumerate(values)], "ts timestamp, metric string, instance string, status string, value double")
    out = counters.counter_increase(samples([5, 8, 2, 4]), ["instance", "status"], 300, 60).orderBy("at").collect()
    assert [r.increase for r in out][:3] == [3.0, 5.0, 7.0] and out[0]["at"] == T0 + timedelta(minutes=1)
    rule = HoldRule("down", "gauge", "m", "critical", 0, 120, look_back=60, below=True, by=("instance",))
    fired = counters.alert_rules(samples([1, 0, 0, 1, 0, 0, 0, 0, 1]), ["instance", "status"], (rule,), 60).collect()
    assert [(r.active_at, r.fired_at, r.last_at) for r in fired] == [(T0 + timedelta(minutes=4), T0 + timedelta(minutes=6), T0 + timedelta(minutes=7))]


def test_repricing(tables, spark):
    t = tables([event(1, "llm.completed", 1, {"callId": "a", "provider": "zai", "model": "GLM-5", "inputTokens": 1000, "outputTokens": 10, "cacheReadTokens": 1000, "cacheWriteTokens": 1000}),
                event(2, "llm.completed", 2, {"callId": "b", "provider": "zai", "model": "glm-5", "inputTokens": 5, "costUsd": 0.25}), event(3, "llm.completed", 3, {"callId": "c", "provider": "x", "model": "y"})])
    prices = pricing.price_dimension(spark.createDataFrame([], "id string, prompt string, completion string"))
    got = dict(rows(pricing.price_calls(t, prices), "call_id", "costUsd"))
    assert got == {"a": pytest.approx(3000 * 0.0000006 + 10 * 0.00000192), "b": 0.25, "c": 0.0}


def test_dashboard_and_plans(tables):
    t = tables(TRACE)
    d = dashboard(t, "2026-07-10 09:00:00", Filters(), "1m")
    assert len(d) >= 16 and d["agents"].count() == 1
    for name, df in d.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan, name


def test_filters_reach_the_scan(spark, tmp_path, tables):
    t = tables(TRACE)
    t.llm_calls.write.parquet(str(tmp_path / "llm_calls"))
    from spanlake.tables import Tables
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = stats.model_stats(Tables(spark, root=str(tmp_path)), Filters(instance="x", start="2026-01-01 00:00:00"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(instance_id,x)" in plan and "GreaterThanOrEqual(started_at" in plan and "span_id" not in plan


def test_pages_miss_no_row_of_equal_time_and_key(spark):
    from spanlake.operators.filters import newest
    df = spark.createDataFrame([(T0, "k", i) for i in "abc"] + [(T0, "j", "a")], "at timestamp, key string, instanceId string")
    seen, cursor = [], None
    while page := newest(df, "at", "key", Filters(limit=1, cursor=cursor)).collect():
        seen += [(page[0].key, page[0].instanceId)]
        cursor = (T0.strftime("%Y-%m-%d %H:%M:%S"), *seen[-1])
    assert seen == [("k", "c"), ("k", "b"), ("k", "a"), ("j", "a")]


def test_uncut_chart_series_count_every_cell(spark):
    df = spark.createDataFrame([(f"p{k % 10}", f"m{k:02d}", k + 1) for k in range(30)], "provider string, model string, requests long")
    shown = charts.series_of(df, ChartSpec("models", ("model", "provider"), "requests"))
    assert (shown.count(), shown.select("category").distinct().count()) == (96, 12)
    assert charts.series_of(df, ChartSpec("models", ("model", "provider"), "requests", categories=5, series=2)).count() == 10
    whole = charts.series_of(df, ChartSpec("models", ("model", "provider"), "requests", categories=None, series=None))
    assert whole.count() == 300 and whole.agg({"value": "sum"}).first()[0] == 465
    assert charts.histogram(whole).agg({"count": "sum"}).first()[0] == 300
    assert charts.gauge(whole).first().value == 1.55
    assert charts.waterfall_steps(whole).agg({"stepEnd": "max"}).first()[0] == 465
    assert max(r.value for r in charts.cumulative(whole).collect()) == 10 + 20 + 30
