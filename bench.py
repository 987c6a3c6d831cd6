"""Runs the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

The driver's tables are first mapped to projection tables and written once, as a deployment would hold
them; that time is reported as ``prepare``.  Each query then runs once cold and once or twice warm on the
written tables, and the value is the sum of the better warm times.  Names as arguments run those queries,
``--all`` runs every registered one, ``--live`` maps the driver's tables inside every query instead.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from spanlake.plans import QUERIES  # noqa: E402
from spanlake.plans.registry import plain  # noqa: E402
from spanlake.sources.adapter import FixtureTables  # noqa: E402

HEADLINE = ["agent_stats", "agent_stats_filtered", "agent_model_stats", "tool_stats", "model_stats", "error_stats", "recent_anomalies", "timeseries_points",
            "timeseries_tools", "cost_trends_day", "cost_summary", "list_sessions", "session_timeline", "metrics_llm", "cpu_percent", "proj_agent_runs",
            "proj_llm_calls", "alerts", "critical_path"]
STORED = {"agent_runs": "run_id", "sessions": "session_id", "subagent_runs": "subagent_id", "llm_calls": "run_id", "tool_calls": "run_id", "mcp_calls": "run_id",
          "retry_events": "run_id", "resource_samples": "event_id", "ledger": "event_id", "raw_events": "event_id"}


class StoredTables(FixtureTables):
    def __init__(self, spark, sf_dir, root):
        super().__init__(spark, sf_dir)
        self.stored = root

    def _load(self, name):
        return self.spark.read.parquet(f"{self.stored}/{name}") if name in STORED else super()._load(name)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if "--all" in sys.argv else [a for a in sys.argv[1:] if a in QUERIES] or HEADLINE
    live, root = "--live" in sys.argv, tempfile.mkdtemp(prefix="run-bench-")
    start = time.perf_counter()
    if not live:
        tables = FixtureTables(spark, sf_dir)
        for name, key in STORED.items():
            tables.get(name).repartition(cpus, key).write.parquet(f"{root}/{name}")
    prepare = round(time.perf_counter() - start, 3)
    warm, cold = {}, {}
    for name in names:
        for i in range(3):
            start = time.perf_counter()
            tables = FixtureTables(spark, sf_dir) if live else StoredTables(spark, sf_dir, root)
            plain(QUERIES[name](tables)).write.format("noop").mode("overwrite").save()
            took = round(time.perf_counter() - start, 3)
            if i == 0:
                cold[name] = took
            else:
                warm[name] = min(took, warm.get(name, took))
            if i == 1 and took > 5:
                break
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total_warm_seconds", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "prepare": prepare,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf_dir, "cpus": cpus}))


main()
