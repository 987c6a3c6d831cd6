"""Reading and writing events, prices, diagnostics and metric snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.pricing import price_dimension
from ..operators.validate import rejection
from ..schemas import LEDGER_COLUMNS, MAX_BATCH_BYTES, MAX_BATCH_EVENTS, WIRE
from ..tables import BUCKET, BUCKETS, ROW_KEYS, key_bucket

DIAGNOSTICS = T.StructType([
    *[T.StructField(n, T.StringType()) for n in (
        "type", "runId", "sessionId", "sessionKey", "callId", "toolCallId", "toolName", "toolSource", "toolOwner", "provider", "model", "channel", "trigger",
        "agentId", "outcome", "errorCategory", "stopReason", "retryReason", "fromProvider", "fromModel", "toProvider", "toModel", "reason",
        "traceId", "spanId", "parentSpanId")],
    T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("attempt", T.IntegerType()),
    *[T.StructField(n, T.DoubleType()) for n in ("durationMs", "timeToFirstByteMs", "timeToFirstTokenMs", "generationDurationMs", "costUsd")],
    *[T.StructField(n, T.LongType()) for n in ("requestPayloadBytes", "responseStreamBytes", "droppedEvents", "queueLength", "queueDepth", "queueCapacity")],
    *[T.StructField(n, T.StructType([T.StructField(k, T.LongType()) for k in ("input", "output", "cacheRead", "cacheWrite")])) for n in ("lastCallUsage", "lastUsage", "usage")],
])


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def ledger_row(wire: Column) -> Column:
    """A parsed envelope as ledger fields; a time that cannot be read is null."""
    fields = []
    for name, column in LEDGER_COLUMNS.items():
        value = wire[name]
        fields.append((value.try_cast("timestamp") if name == "occurredAt" else value).alias(column))
    return F.struct(*fields)


def batches_of(df: DataFrame, batch_id: Column, received_at: Column, text: str = "value", size: Column | None = None) -> DataFrame:
    """(batch_id, received_at, bytes, events) from one JSON array text per batch; unreadable text has no events.

    ``size`` is the size in bytes where it is known without the text, which may then be null.
    """
    events = F.transform(F.from_json(text, T.ArrayType(WIRE)), ledger_row)
    size = F.octet_length(text) if size is None else size
    return df.select(batch_id.alias("batch_id"), received_at.alias("received_at"), size.cast("bigint").alias("bytes"), F.coalesce(events, F.array().cast(ledger_type())).alias("events"))


def ledger_type() -> T.ArrayType:
    kinds = {f.name: f.dataType for f in WIRE.fields}
    return T.ArrayType(T.StructType([T.StructField(c, T.TimestampType() if n == "occurredAt" else kinds[n]) for n, c in LEDGER_COLUMNS.items()]))


def _files(load) -> DataFrame:
    """Batch files, each a row.  The size is looked at before the content: a file above the limit is named, never read."""
    files = load()
    small = files.where(F.col("length") <= MAX_BATCH_BYTES).withColumn("value", F.col("content").cast("string")).drop("content")
    large = load().where(F.col("length") > MAX_BATCH_BYTES).drop("content").withColumn("value", F.lit(None).cast("string"))
    return batches_of(small.unionByName(large), F.col("path"), F.col("modificationTime"), size=F.col("length"))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch file, each a JSON array of envelopes."""
    return _files(lambda: spark.read.format("binaryFile").load(path))


def stream_batches(spark: SparkSession, path: str) -> DataFrame:
    return _files(lambda: spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path))


def stream_kafka(spark: SparkSession, **options: str) -> DataFrame:
    """Batches from a topic: one message per batch, arrival as the broker stamped it."""
    df = spark.readStream.format("kafka").options(**options).load()
    ident = F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return batches_of(df.withColumn("value", F.col("value").cast("string")), ident, F.col("timestamp"))


def events_of(batches: DataFrame) -> DataFrame:
    return batches.select("batch_id", "received_at", F.inline("events"))


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """Every envelope of every batch file, not yet validated."""
    return events_of(read_batches(spark, path))


def batch_problem(now: str | None = None) -> Column:
    """Why a whole batch is turned away, null when it is taken.  A batch is one row, so this needs no shuffle."""
    bad = F.exists("events", lambda e: rejection(now, lambda name: e[name]).isNotNull())
    return (F.when(F.col("bytes") > MAX_BATCH_BYTES, "batch_bytes").when(~F.size("events").between(1, MAX_BATCH_EVENTS), "batch_events").when(bad, "bad_event"))


def accepted(batches: DataFrame, now: str | None = None) -> DataFrame:
    """Events of the batches in which every event is valid."""
    return events_of(batches.where(batch_problem(now).isNull()))


def read_envelope_texts(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes with the names of keys the schema does not know, for the contract check."""
    df = spark.read.option("wholetext", True).text(path)
    texts = df.select(F.explode(F.from_json("value", T.ArrayType(T.StringType()))).alias("text"))
    known = F.array(*[F.lit(n) for n in LEDGER_COLUMNS])
    return texts.select(ledger_row(F.from_json("text", WIRE)).alias("e"), F.array_except(F.json_object_keys("text"), known).alias("unknown_keys")).select("e.*", "unknown_keys")


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Runtime diagnostics, one JSON object per line; only the listed fields are read, never content."""
    raw = spark.read.schema(DIAGNOSTICS).json(path)
    spent = F.coalesce("lastCallUsage", "lastUsage", "usage")
    special = {"ts", "lastCallUsage", "lastUsage", "usage", "requestPayloadBytes", "responseStreamBytes", "droppedEvents", "queueLength", "queueDepth"}
    cols = [F.col(n).alias(_snake(n)) for n in raw.columns if n not in special]
    return raw.select(*cols, F.timestamp_millis("ts").alias("ts"), F.col("requestPayloadBytes").alias("request_bytes"), F.col("responseStreamBytes").alias("response_bytes"),
                      F.col("droppedEvents").alias("dropped"), F.coalesce("queueDepth", "queueLength").alias("queue_depth"),
                      spent["input"].alias("usage_input"), spent["output"].alias("usage_output"), spent["cacheRead"].alias("usage_cache_read"), spent["cacheWrite"].alias("usage_cache_write"),
                      F.md5(F.concat_ws("|", "type", F.col("ts").cast("string"), F.col("seq").cast("string"))).alias("line_id"))


def read_pricing(spark: SparkSession, path: str) -> DataFrame:
    """The price dimension from a price file ``{"data": [{"id", "pricing": {"prompt", "completion"}}]}``."""
    kind = "data array<struct<id: string, pricing: struct<prompt: string, completion: string>>>"
    return price_dimension(spark.read.schema(kind).option("multiLine", True).json(path).select(F.inline("data")).select("id", "pricing.prompt", "pricing.completion"))


def write_ledger(df: DataFrame, path: str, mode: str = "append") -> None:
    """Events by the day they happened, one shuffle so each day is few files."""
    dated = df.withColumn("event_date", F.to_date("occurred_at"))
    dated.repartition("event_date", F.pmod(F.xxhash64("event_id"), F.lit(16))).write.mode(mode).partitionBy("event_date").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_projections(frames: dict[str, DataFrame], root: str, changed: dict[str, DataFrame] | None = None) -> None:
    """Finished projections in folders by a hash of their key.

    With ``changed``, which has the keys of new and altered rows by projection, only the folders of those keys are
    written anew, whole, and all others stay as they are; a projection without an entry is not touched.
    """
    for name, df in frames.items():
        placed = df.withColumn(BUCKET, key_bucket(*map(F.col, ROW_KEYS[name])))
        if changed is not None:
            if name not in changed:
                continue
            touched = changed[name].select(key_bucket(*map(F.col, ROW_KEYS[name])).alias(BUCKET)).distinct()
            placed = placed.join(touched, BUCKET, "left_semi")
        spread = F.pmod(F.floor(F.xxhash64(*ROW_KEYS[name]) / BUCKETS), F.lit(16))  # several tasks and files a folder
        (placed.repartition(BUCKET, spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if changed is not None else "static")
         .partitionBy(BUCKET).parquet(f"{root}/{name}"))
        if changed is None and df.isEmpty():  # a file without rows tells readers the columns
            df.write.mode("overwrite").parquet(f"{root}/{name}/{BUCKET}=0")


def write_metric_snapshot(snapshot: DataFrame, path: str) -> None:
    """Appends (ts, metric, labels, value) rows by metric."""
    snapshot.write.mode("append").partitionBy("metric").parquet(path)
