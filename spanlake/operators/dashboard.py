"""Everything the front page asks for, over shared tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from ..tables import Tables
from . import lists, stats, timeseries
from .filters import Filters


def dashboard(t: Tables, now: str, p: Filters = Filters(), bucket: str = "1h") -> dict[str, DataFrame]:
    """Named frames; lists show up to 200 rows, costs also cover the last 7 and 30 days.

    All frames read the same tables, so a caller who shows several should persist the tables first.
    """
    p = p.but(limit=200)
    at = datetime.fromisoformat(now)

    def last(days: int) -> Filters:
        return p.but(start=str(at - timedelta(days=days)), end=str(at))

    return {
        "status": lists.status_summary(t), "instances": lists.list_instances(t),
        **{"timeseries_" + name: df for name, df in timeseries.timeseries(t, p, bucket).items()},
        "models": stats.model_stats(t, p, stats.PAGE), "tools": stats.tool_stats(t, p, stats.PAGE), "agents": stats.agent_stats(t, p), "agentModels": stats.agent_model_stats(t, p),
        "lifetime": stats.lifetime_stats(t), "sessions": lists.list_sessions(t, p, 0), "llmCalls": lists.list_llm_calls(t, p), "errors": stats.error_stats(t, p, stats.PAGE),
        "anomalies": stats.recent_anomalies(t, p), "subagents": lists.list_subagents(t, p), "mcpCalls": lists.list_mcp_calls(t, p),
        "costTrends": timeseries.cost_trends(t, last(6), "day"), "costSummary": timeseries.cost_summary(t, p, now), "costTrends30d": timeseries.cost_trends(t, last(30), "day"),
    }
