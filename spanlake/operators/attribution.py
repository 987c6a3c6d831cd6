"""Which agent a run, and through it a call, belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..tables import Tables
from .filters import Filters, blank_to, narrowed

RUN_KEY = ["instance_id", "run_id"]


def run_agents(t: Tables, p: Filters | None = None) -> DataFrame:
    """Every run with its agent: own, else the subagent's, else the session's, else ``unknown``.

    The two sides are unique on their keys and hold only rows that can supply a name.
    """
    runs = t.agent_runs
    if p is not None:
        runs = narrowed(runs, p.but(status=None))
    subs = (t.subagent_runs.where("agent_id <> ''")
            .select("instance_id", F.col("subagent_id").alias("run_id"), F.col("agent_id").alias("sub_agent")))
    sess = (t.sessions.where("agent_id <> ''")
            .select("instance_id", "session_id", F.col("agent_id").alias("session_agent")))
    df = (runs.withColumn("own_agent", F.nullif("agent_id", F.lit(""))).drop("agent_id")
          .join(sess, ["instance_id", "session_id"], "left")
          .join(subs, RUN_KEY, "left")
          .withColumn("agent_id", F.coalesce("own_agent", "sub_agent", "session_agent", F.lit("unknown")))
          .drop("own_agent", "sub_agent", "session_agent"))
    if p is not None:
        df = narrowed(df, Filters(status=p.status, agent=p.agent), agent="agent_id")
    return df


def of_runs(calls: DataFrame, t: Tables, p: Filters) -> DataFrame:
    """The calls of runs that the filters on a run's own columns let through; all calls without such a filter.

    The runs are few columns of one table, cut by the filter in the scan, so Spark sends them to the calls where they are few.
    """
    if p.but(agent=None) == Filters(limit=p.limit):
        return calls
    runs = narrowed(t.agent_runs, p.but(agent=None)).select(*RUN_KEY)
    return calls.join(runs, RUN_KEY, "left_semi")


def with_agent(df: DataFrame, t: Tables, p: Filters, extra: list[str] | None = None) -> DataFrame:
    """Adds ``agent_id`` to rows that carry (instance_id, run_id) and applies the agent filter."""
    t_runs = run_agents(t).select(*RUN_KEY, "agent_id", *[F.col(c).alias("run_" + c) for c in extra or []])
    df = df.join(t_runs, RUN_KEY, "left").withColumn("agent_id", F.coalesce("agent_id", F.lit("unknown")))
    return narrowed(df, Filters(agent=p.agent), None, None, "agent_id")


class Measure:
    """An additive measure: summed or maximised per run first, then again over the result."""

    def __init__(self, name: str, expr: str | Column, kind: str = "sum"):
        self.name, self.kind = name, kind
        self.expr = expr

    def first(self) -> Column:
        expr = F.expr(self.expr) if isinstance(self.expr, str) else self.expr
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](expr).alias(self.name)

    def again(self) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.name).alias(self.name)


def rolled_up(calls: DataFrame, t: Tables, p: Filters, dims: list[str], measures: list[Measure],
              by_agent: bool = False) -> DataFrame:
    """Measures of calls by ``dims`` (and agent).

    Calls are summed per run before they meet the runs, so one run with a third of all
    calls is a single row in the join.  Without an agent to show or to filter on, no join is made.
    """
    if not by_agent and not p.agent:
        return calls.groupBy(*dims).agg(*[m.first() for m in measures])
    per_run = calls.groupBy(*RUN_KEY, *dims).agg(*[m.first() for m in measures])
    keys = dims + (["agent_id"] if by_agent else [])
    return with_agent(per_run, t, p).groupBy(*keys).agg(*[m.again() for m in measures])


def llm_named(df: DataFrame) -> DataFrame:
    return df.withColumn("provider", blank_to("provider")).withColumn("model", blank_to("model"))


def tool_events(t: Tables) -> DataFrame:
    """Tool and server-tool calls as one table with a source mark."""
    cols = ["instance_id", "run_id", "status", "duration_ms", "started_at", "ended_at", "error_category", "attempt", "retry_reason"]
    tools = t.tool_calls.select(F.lit("tool").alias("source"), blank_to("tool_name").alias("tool"), "session_id", *cols)
    mcp = t.mcp_calls.select(F.lit("mcp").alias("source"), blank_to("tool_name").alias("tool"), "session_id", *cols)
    return tools.unionByName(mcp)
