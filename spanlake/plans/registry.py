"""Named queries over the driver's tables, each with the statement that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.adapter import FixtureTables, duckdb_ctes
from .shared import EVERY_CALL

QUERIES: dict[str, Callable[[FixtureTables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, build: Callable[[FixtureTables], DataFrame], tables: tuple[str, ...] = (), oracle: str | None = None,
          ctes: tuple[str, ...] = ()) -> None:
    QUERIES[name] = build
    if oracle is not None:
        every = [EVERY_CALL] if any("every_call" in text for text in (*ctes, oracle)) else []
        parts = ([duckdb_ctes(*tables)] if tables else []) + every + list(ctes)
        head = "WITH RECURSIVE " if "recursive" in oracle[:60].lower() or any("/*recursive*/" in c for c in ctes) else "WITH "
        ORACLES[name] = (head + ",\n".join(parts) + "\n" if parts else "") + oracle.strip()


def plain(df: DataFrame) -> DataFrame:
    """Instants as zone-free UTC timestamps, so both engines show the same values."""
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = FixtureTables(prepared(spark), sf_dir)
    # shuffles begin with as many partitions as the tables need, so that a task's share does not grow; adaptive execution joins small ones
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tables.width("lineitem"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    return plain(QUERIES[name](tables))
