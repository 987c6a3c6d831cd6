"""Work per task and per shuffled row does not grow with the tables."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import T0, event

from spanlake.functions.text import packed, unpacked
from spanlake.operators import diagnostics, lists, reduce, trace, validate
from spanlake.plans import queries_ledger, registry
from spanlake.sources import adapter

SF = "/root/testdata/sf0.001"


def test_dedup_carries_what_is_asked(spark, ledger):
    first, later = event(1, "llm.started", 0, {"a": 1}, arrival=5), event(1, "llm.failed", 0, {"a": 2}, arrival=9)
    other = event(2, "tool.started", 0, {"b": 1})
    df = ledger([later, first, other])
    whole = {r.event_id: r for r in validate.dedup_events(df).collect()}
    assert whole[first[1]].event_type == "llm.started" and len(whole) == 2
    slim = validate.dedup_events(df, ["sequence", "event_type"])
    assert slim.columns == ["sequence", "event_type"]
    assert sorted(map(tuple, slim.collect())) == sorted((r.sequence, r.event_type) for r in whole.values())
    some = {r.event_id: r.payload for r in validate.dedup_events(df, df.columns, ("llm",)).collect()}
    assert some == {first[1]: whole[first[1]].payload, other[1]: None}


def test_copies_that_arrive_together_are_the_same_copy_in_every_form(ledger):
    one = event(1, "llm.started", 0, {"a": 1})
    df = ledger([one, (*one[:2], "tool.started", *one[3:]), (*one[:9], '{"a": 2}', *one[10:])])
    kept = validate.dedup_events(df).collect()[0]
    assert validate.dedup_events(df, ["event_type"]).collect()[0].event_type == kept.event_type
    assert validate.dedup_events(df, ["payload"]).collect()[0].payload == kept.payload


def test_intake_tasks_grow_in_number_with_stored_bytes(spark, monkeypatch):
    few = adapter.FixtureTables(spark, SF).get("wide:lineitem").rdd.getNumPartitions()
    monkeypatch.setattr(adapter, "SPREAD_BYTES", 1 << 10)
    many = adapter.FixtureTables(spark, SF).get("wide:lineitem").rdd.getNumPartitions()
    assert few == spark.sparkContext.defaultParallelism < many


def test_lines_are_not_shuffled_by_customer(spark):
    """Even where nothing is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = adapter.FixtureTables(spark, SF)
        for name, key in (("raw_lines", "o_custkey"), ("tool_calls", "o_custkey"), ("llm_calls", "o_custkey")):
            plan = t.get(name)._jdf.queryExecution().executedPlan().toString().split("\n")
            depth = [len(row) - len(row.lstrip(" :+-")) for row in plan]
            shuffles = [i for i, row in enumerate(plan) if "Exchange hashpartitioning(" + key in row]
            assert shuffles
            for i in shuffles:
                end = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
                assert not any("l_orderkey" in row for row in plan[i + 1:end]), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["raw_lines", "order_events", "hooks", "lines", "llm_calls", "tool_calls", "mcp_calls", "retry_events"])
def test_spark_builds_the_rows_of_the_shared_text(spark, monkeypatch, name):
    built = adapter.FixtureTables(spark, SF).get(name)
    monkeypatch.setattr(adapter, "SPARK_SQL", {})
    monkeypatch.setattr(adapter, "SPREAD_IN", {})
    plain = adapter.FixtureTables(spark, SF).get(name)
    assert built.dtypes == plain.dtypes
    assert built.exceptAll(plain).isEmpty() and plain.exceptAll(built).isEmpty()


def test_folds_of_one_family_read_the_payloads_of_that_family(spark):
    rows = queries_ledger.clean_of(adapter.FixtureTables(spark, SF), "mcp").select("event_type", "payload").collect()
    assert rows and {r.event_type.split(".")[0] for r in rows} == {"mcp"} and all(r.payload for r in rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_that_arrive_again_are_copied_from_the_rows_made(spark, monkeypatch):
    built = adapter.FixtureTables(spark, SF).raw_events
    monkeypatch.setattr(adapter, "SPARK_SQL", {k: v for k, v in adapter.SPARK_SQL.items() if k != "raw_events"})
    plain = adapter.FixtureTables(spark, SF).raw_events
    assert plan_of(built).count("Join") < plan_of(plain).count("Join")
    assert built.dtypes == plain.dtypes
    assert built.exceptAll(plain).isEmpty() and plain.exceptAll(built).isEmpty()


def test_orders_are_not_sent_to_every_task(spark):
    """Their files are small, their rows are not; only nations are sent."""
    for name in ("owners", "order_events"):
        plan = plan_of(adapter.FixtureTables(spark, SF).get(name))
        sent = [row for row in plan.split("\n") if "BroadcastHashJoin" in row]
        assert sent and all("c_nationkey" in row for row in sent), name


def test_tasks_that_join_orders_grow_in_number_with_stored_bytes(spark, monkeypatch):
    monkeypatch.setattr(adapter, "SPREAD_BYTES", 1 << 10)
    t = adapter.FixtureTables(spark, SF)
    width = t.width("orders")
    assert width > spark.sparkContext.defaultParallelism
    assert "hashpartitioning(o_custkey" in plan_of(t.get("owners")) and f", {width}), REPARTITION_BY_NUM" in plan_of(t.get("owners"))


def test_tables_of_many_files_are_spread_by_their_bytes(spark, monkeypatch, tmp_path):
    """A table of many small files is packed into few tasks by its scan and by the joins above it."""
    for name in ("nation", "part"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("customer", "orders", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(24).write.parquet(f"{tmp_path}/{name}.parquet")
    t = adapter.FixtureTables(spark, str(tmp_path))
    stored = sum(f.stat().st_size for f in (tmp_path / "orders.parquet").glob("*.parquet"))
    monkeypatch.setattr(adapter, "SPREAD_BYTES", stored // 16)
    assert len(t.get("raw:orders").inputFiles()) > t.width("orders") >= 16
    for table, key in (("owners", "o_custkey"), ("order_events", "o_orderkey"), ("raw_lines", "l_orderkey")):
        width = t.width("lineitem" if key == "l_orderkey" else "orders")
        assert re.search(rf"hashpartitioning\({key}#\d+L?, {width}\), REPARTITION_BY_NUM", plan_of(t.get(table))), table
    one = adapter.FixtureTables(spark, SF).get("order_events")
    assert one.exceptAll(t.get("order_events")).isEmpty() and t.get("order_events").exceptAll(one).isEmpty()


def test_copies_go_before_and_after_the_shuffle_without_states(spark):
    plan = plan_of(queries_ledger.clean_of(adapter.FixtureTables(spark, SF), "llm"))
    assert plan.count("WindowGroupLimit") == 2 and "SortAggregate" not in plan


def test_family_of_an_event_type(spark):
    kinds = ["llm.started", "llm", "llmx.started", "tool.llm", "mcp.failed", None]
    rows = spark.createDataFrame([(k,) for k in kinds], "event_type string").where(validate.in_families("llm", "mcp")).collect()
    assert {r.event_type for r in rows} == {"llm.started", "llm", "mcp.failed"}


def test_priorities_carry_two_columns_of_an_event(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries_ledger.validate, "dedup_events", lambda df, columns=None, of=None: asked.append(columns) or df)
    registry.QUERIES["priority_counts"](adapter.FixtureTables(spark, SF))
    assert asked == [["event_type", "payload"]]


def test_raised_counters_meet_finished_calls(ledger, monkeypatch):
    """The wide states of calls are combined once; only counters are raised, by records without a call."""
    def refused(*_):
        raise AssertionError("states combined twice")
    monkeypatch.setattr(reduce, "merge_states", refused)
    rows = [event(1, "llm.started", 0, {"callId": "c", "runId": "r", "model": "m", "inputTokens": 5, "outputTokens": 9}, arrival=1),
            event(2, "llm.started", 1, {"accountingUpdate": True, "runId": "r", "inputTokens": 7, "outputTokens": 3}, arrival=2),
            event(3, "llm.started", 1, {"callId": "d", "runId": "q", "inputTokens": 4}, arrival=3)]
    calls = {r.call_id: r for r in reduce.reduce_llm_calls(ledger(rows)).collect()}
    assert [(calls[c].run_id, calls[c].model, calls[c].input_tokens, calls[c].output_tokens, calls[c].cost_usd) for c in "cd"] == [("r", "m", 7, 9, 0), ("q", "", 4, 0, 0)]


def shuffles_of(spark, df, key):
    """Shuffles by the key that a plan makes, without those it reads again."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = plan_of(df.select("*")).split("\n")
    finally:
        for name in settings:
            spark.conf.unset(name)
    return sum(f"Exchange hashpartitioning({key}#" in row and "ReusedExchange" not in row for row in rows)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_calls_that_lack_a_trace_or_parent_meet_their_run(spark):
    plan = optimized(lists.timeline_spans(adapter.FixtureTables(spark, SF)))
    assert re.search(r"Filter \(?\(?isnull\(trace_id#\d+\) OR isnull\(parent_span_id#\d+\)", plan)
    assert re.search(r"Filter \(?\(?isnotnull\(trace_id#\d+\) AND isnotnull\(parent_span_id#\d+\)", plan)


def test_spans_of_a_waterfall_are_made_once_and_meet_no_run_or_part(spark):
    df = trace.waterfall_layout(adapter.FixtureTables(spark, SF))
    assert "LeftOuter" not in optimized(df)
    assert shuffles_of(spark, df, "l_orderkey") == 4  # model, tool and server-tool calls, retries


def test_spans_of_edges_are_made_once_and_homes_are_asked_by_the_homeless(spark):
    df = trace.trace_edges(adapter.FixtureTables(spark, SF))
    assert shuffles_of(spark, df, "l_orderkey") == 4
    assert re.search(r"Filter isnull\(parent_kind#\d+\)", optimized(df))


def test_packed_ids_come_back(spark):
    ids = ["a" * 32, "A" * 32, "0" * 31, "ab", "", "x" * 64, "é-1", "00000001-0000-4000-8000-00000000000a", "00000001-0000-4000-8000-00000000000A", "0000000100004000-8000-00000000-0000a", "-" * 36, None]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(2).select("id", packed(F.col("id")).alias("code"))
    got = {r.id: (len(r.code) if r.code is not None else None, r.back) for r in df.select("*", unpacked(F.col("code")).alias("back")).collect()}
    assert {i: back for i, (_, back) in got.items()} == {i: i for i in ids}
    assert (got["a" * 32][0], got["00000001-0000-4000-8000-00000000000a"][0], got["A" * 32][0]) == (17, 17, 33)


def test_large_and_small_keys_find_the_same_calls(spark):
    """Records without a place in the sequence too."""
    cols = "type string, ts timestamp, seq bigint, line_id string, run_id string, session_id string, session_key string, call_id string, provider string, usage_input bigint"
    at = [T0 + timedelta(minutes=m) for m in (0, 50, 100, 150, 200)]
    df = spark.createDataFrame([
        ("model.call.started", at[0], 1, "a1", "r", "s", None, "c1", "p", None), ("model.usage", at[1], 2, "u1", "r", "s", None, None, None, 5),
        ("model.call.error", at[2], 3, "a2", None, "s", "k", "c2", "q", None), ("model.usage", at[3], 4, "u2", "other", "s", None, None, None, 6),
        ("model.usage", at[4], None, "u3", "r", "s", "k", None, None, 7), ("model.usage", at[4], 5, "u4", "none", None, None, None, None, 8),
        ("model.usage", at[4], 6, "u5", None, None, None, None, None, 9)], cols)
    small = sorted(map(tuple, diagnostics.attribute_usage(df).select("line_id", "call_id", "event_type", "provider", "run_id", "input_tokens").collect()))
    assert small == [("u1", "c1", "llm.completed", "p", "r", 5), ("u2", "c2", "llm.failed", "q", None, 6), ("u3", "c1", "llm.completed", "p", "r", 7),
                     ("u4", None, "llm.completed", None, "none", 8), ("u5", None, "llm.completed", None, None, 9)]
    large = diagnostics.attribute_usage(df, largest=1)
    assert sorted(map(tuple, large.select("line_id", "call_id", "event_type", "provider", "run_id", "input_tokens").collect())) == small


def test_usage_meets_calls_in_one_shuffle_of_narrow_rows(spark):
    df = diagnostics.attribute_usage(adapter.FixtureTables(spark, SF).diagnostics)
    plan = optimized(df)
    assert "_slice" not in plan and "trace_id" not in plan and "channel" not in plan
    rows = plan.split("\n")
    scan = next(i for i, row in enumerate(rows) if "Relation" in row and "l_linenumber" in row)
    assert "Filter" in rows[scan - 1] and "model.usage" in rows[scan - 1]  # other records are left out by the scan


def test_ids_travel_as_bytes_and_other_families_by_id_and_arrival_only(spark, ledger):
    t = adapter.FixtureTables(spark, SF)
    for df in (queries_ledger.clean_of(t, "llm"), queries_ledger.clean(t, "event_id", "producer_id", "sequence", "occurred_at")):
        plan = optimized(df)
        assert re.search(r"Window \[row_number\(\).*\[_id#\d+\]", plan)
    other = validate.dedup_events(ledger([event(1, "llm.started", 0, {"a": 1}), event(2, "tool.started", 0, {"b": 1})]), ["event_id", "event_type", "occurred_at", "received_at"], ("llm",))
    got = {r.event_id[:8]: (r.event_type, r.occurred_at, r.received_at) for r in other.collect()}
    assert got == {"00000001": ("llm.started", T0, T0 + timedelta(seconds=1)), "00000002": (None, None, T0 + timedelta(seconds=2))}


def test_an_earlier_copy_of_another_family_still_counts(ledger):
    first, later = event(1, "tool.started", 0, {}, arrival=1), event(1, "llm.started", 0, {"callId": "c"}, arrival=2)
    df = validate.dedup_events(ledger([later, first]), ["event_id", "event_type"], ("llm",))
    assert df.where(validate.in_families("llm")).isEmpty() and df.count() == 1


def test_regressions_shuffle_ids_as_bytes_and_order_them_as_text(spark):
    at = [T0 + timedelta(minutes=m) for m in range(3)]
    rows = [("zz", "p", 1, at[0]), ("ab" * 16, "p", 1, at[2]), ("AB", "p", 1, at[1]), ("cd" * 16, "p", 2, at[1])]
    df = validate.time_regressions(spark.createDataFrame(rows, "event_id string, producer_id string, sequence bigint, occurred_at timestamp"))
    assert sorted((r.event_id, r.latest_before) for r in df.collect()) == [("cd" * 16, at[2]), ("zz", at[2])]
    assert re.search(r"RepartitionByExpression[^\n]*\n[^\n]*Project [^\n]* AS _id#", optimized(df))


def test_rows_of_calls_name_their_arrival_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(reduce, "written", lambda df, *codec: seen.append((df.columns, codec)) or df)
    rows = reduce.call_rows(queries_ledger.clean_of(adapter.FixtureTables(spark, SF), "llm"))
    assert "_ord" not in seen[0][0] and seen[0][1] == ("zstd",) and "_ord" in rows.columns


def test_large_and_small_calls_fold_alike_and_small_ones_are_dealt_as_rows(spark, ledger):
    rows = [event(n, f"llm.{('started', 'completed')[n % 2]}", n, {"callId": f"c{n // 3}", "runId": "r", "model": f"m{n}", "inputTokens": n}, arrival=90 - n, ident=("ab" * 16, f"{n:032x}")[n > 0])
            for n in range(7)] + [event(9, "llm.started", 0, {"runId": "r"})]
    made = reduce.call_rows(ledger(rows))
    plain = sorted(map(str, reduce.finish(reduce.fold_rows(made, reduce.LLM), reduce.LLM).collect()))
    for largest in (0, 2, reduce.LARGEST):
        assert sorted(map(str, reduce.finish(reduce.fold_dealt(made, reduce.LLM, largest=largest), reduce.LLM).collect())) == plain
    assert len(plain) == 3
    plan = plan_of(reduce.reduce_llm_calls(ledger(rows)))
    assert re.search(r"Exchange hashpartitioning\(instance_id#\d+, call_id#\d+, \d+\), REPARTITION_BY_COL", plan)


def test_matching_alone_writes_the_columns_it_needs(spark, ledger, monkeypatch):
    seen = []
    monkeypatch.setattr(reduce, "written", lambda df, *codec: seen.append(df.columns) or df)
    reduce.match_usage(ledger([event(1, "llm.started", 0, {"callId": "c", "runId": "r"})]))
    assert "run_id" in seen[0] and "duration_ms" not in seen[0] and "_ord" not in seen[0]
