import json
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

T0 = datetime(2026, 7, 10, 8, 0, 0)
LEDGER = ("schema_version int, event_id string, event_type string, occurred_at timestamp, instance_id string, producer_id string, process_id int, "
          "sequence bigint, source string, payload string, received_at timestamp, batch_id string")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
         .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def event(n, kind, second, payload, arrival=None, instance="local-test", pid=1234, batch="b", ident=None):
    ident = ident or f"{n:08d}-0000-4000-8000-{n:012d}"
    at = T0 + timedelta(seconds=second)
    return (1, ident, kind, at, instance, "plugin-test", pid, n, "plugin", json.dumps(payload), T0 + timedelta(seconds=arrival if arrival is not None else n), batch)


@pytest.fixture()
def ledger(spark):
    return lambda events: spark.createDataFrame(events, LEDGER)


@pytest.fixture()
def tables(spark, ledger):
    from spanlake.operators.reduce import rebuild
    from spanlake.tables import Tables

    def build(events):
        df = ledger(events)
        return Tables(spark, {**rebuild(df), "ledger": df})
    return build


def rows(df, *cols):
    return [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
