"""The projection tables and the ledger, each a DataFrame loaded on first use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PROJECTIONS = ("instances", "sessions", "agent_runs", "llm_calls", "tool_calls", "mcp_calls",
               "subagent_runs", "retry_events", "resource_samples")

# what names a row of each projection
ROW_KEYS = {"instances": ["instance_id"], "sessions": ["instance_id", "session_id"], "agent_runs": ["instance_id", "run_id"], "llm_calls": ["instance_id", "call_id"],
            "tool_calls": ["instance_id", "tool_call_id"], "mcp_calls": ["instance_id", "call_id"], "subagent_runs": ["instance_id", "subagent_id"],
            "retry_events": ["event_id"], "resource_samples": ["event_id"]}
BUCKET, BUCKETS = "key_bucket", 64


def key_bucket(*key: Column) -> Column:
    """The folder of a written projection that holds a key."""
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


class Tables:
    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame] | None = None, root: str | None = None):
        self.spark = spark
        self.root = root
        self._frames = dict(frames or {})
        self._given = frozenset(self._frames)

    def get(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._load(name)
        return self._frames[name]

    def _load(self, name: str) -> DataFrame:
        if self.root is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}").drop(BUCKET)

    def row(self, name: str, *key: str) -> DataFrame:
        """The row of one key; of a projection written in key buckets only the key's folder is read."""
        columns = ROW_KEYS[name]
        if len(key) != len(columns):
            raise ValueError(f"a key of {name} is {', '.join(columns)}")
        df = self.get(name) if name in self._given or self.root is None else self.spark.read.parquet(f"{self.root}/{name}")
        if BUCKET in df.columns:
            df = df.where(F.col(BUCKET) == key_bucket(*map(F.lit, key))).drop(BUCKET)
        for column, value in zip(columns, key):
            df = df.where(F.col(column) == value)
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "root"):
            raise AttributeError(name)
        return self.get(name)
