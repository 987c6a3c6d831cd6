"""Projection states kept up to date batch by batch.

State rows hold ``struct(ord, v)`` columns (see ``reduce``), so the states of two batches merge with
the aggregates that built them, in any order.  A batch therefore only appends its own states; readers
merge what is there, and every few appends are merged into one, so a row is rewritten a logarithmic
number of times.  One manifest file, made visible by a rename, switches the ledger and all tables to the
new version at once.  What makes an event new is its id alone, over the whole ledger, so a repeated batch changes
nothing and a batch is never skipped for its number; the manifest keeps the highest number per stream as progress.

Ids known so far lie beside the ledger, without payloads, in runs that merge by the same levels.  A run is cut into
folders by a hash of the id, as many as keep a folder near ``ids_per_folder`` rows, so a batch of n ids reads at most n
folders of a run, however large the ledger is.
"""

from __future__ import annotations

import json
from functools import reduce as _fold

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lineage import scratch, written
from ..tables import Tables
from . import reduce as R
from .retention import PROJECTION_TIMES, Retention, expired
from .validate import dedup_events

FANOUT = 8      # appends of one level that are merged into the next
IDS_PER_FOLDER = 1 << 20
ID_FOLDER = "id_folder"

BY_TABLE = {e.table: e for e in R.ENTITIES}
KEYS = {"instances": ["instance_id"], "sessions": ["instance_id", "session_id"], **{e.table: ["instance_id", e.key] for e in R.ENTITIES},
        "retry_events": ["event_id"], "resource_samples": ["event_id"]}
APPEND_ONLY = ("retry_events", "resource_samples")
EMPTY = {"version": -1, "streams": {}, "tables": {}, "ledger": [], "ledger_from": None, "ids": []}


def id_folder(folders: int) -> Column:
    return F.pmod(F.xxhash64("event_id"), F.lit(folders)).cast("int")


def merged(name: str, states: DataFrame) -> DataFrame:
    if name in BY_TABLE:
        return R.merge_states(states, BY_TABLE[name]).select(*states.columns)
    return R.merge_session_states(states).select(*states.columns) if name == "sessions" else states


def finished(name: str, state: DataFrame) -> DataFrame:
    if name in BY_TABLE:
        return R.finish(state, BY_TABLE[name])
    if name == "sessions":
        return R.finish_sessions(state)
    return R.finish_instances(state) if name == "instances" else state


class StateStore:
    """Versioned state tables and ledger under one folder all executors can reach."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, ids_per_folder: int = IDS_PER_FOLDER):
        self.spark, self.root, self.fanout, self.ids_per_folder = spark, root.rstrip("/"), fanout, ids_per_folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    # --- manifests -----------------------------------------------------------------

    def manifest(self) -> dict:
        names = [n for n in self._names(f"{self.root}/manifests") if n.endswith(".json")]
        if not names:
            return {**EMPTY, "ids": []}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/manifests/{names[-1]}").head()[0])

    def _commit(self, manifest: dict) -> None:
        part = self._path(f"{self.root}/manifests/.{manifest['version']}.tmp")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._path(f"{self.root}/manifests/{manifest['version']:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(part, final):
            raise RuntimeError(f"version {manifest['version']} was written by another job")

    def vacuum(self) -> None:
        """Deletes what the newest manifest no longer names; readers of older versions must be done."""
        m = self.manifest()
        entries = {**{name: m["tables"].get(name, []) for name in KEYS}, "ids": m.get("ids", [])}
        for name in entries:
            used = {entry[0] for entry in entries[name]}
            for n in self._names(f"{self.root}/{name}"):
                if n not in used:
                    self._fs.delete(self._path(f"{self.root}/{name}/{n}"), True)

    # --- reading ---------------------------------------------------------------------

    def _parts(self, m: dict, name: str) -> DataFrame | None:
        """State rows as they were appended, several per entity."""
        paths = [f"{self.root}/{name}/{path}" for path, _ in m["tables"].get(name, [])]
        return self.spark.read.parquet(*paths) if paths else None

    def _state(self, m: dict, name: str) -> DataFrame | None:
        parts = self._parts(m, name)
        return parts if parts is None or len(m["tables"][name]) == 1 else merged(name, parts)

    def ledger(self, m: dict | None = None) -> DataFrame | None:
        m = m or self.manifest()
        paths = [f"{self.root}/ledger/v={v}" for v in m["ledger"]]
        paths = [p for p in paths if any(n.startswith("event_date=") for n in self._names(p))]
        if not paths:
            return None
        df = self.spark.read.option("basePath", f"{self.root}/ledger").parquet(*paths).drop("v")
        if m["ledger_from"]:
            at = F.lit(m["ledger_from"]).cast("timestamp")
            df = df.where((F.col("event_date") >= F.to_date(at)) & (F.col("occurred_at") >= at))
        return df

    def tables(self) -> Tables:
        """The finished projections and the ledger of the newest version."""
        m = self.manifest()
        frames = {name: finished(name, state) for name in KEYS if (state := self._state(m, name)) is not None}
        ledger = self.ledger(m)
        if ledger is not None:
            frames["ledger"] = ledger
        return Tables(self.spark, frames)

    # --- writing ----------------------------------------------------------------------

    def _ids(self, m: dict, entries: list) -> DataFrame:
        """Ids of some runs, each in its own folders; those of days that were purged are no longer known."""
        parts = [self.spark.read.schema(f"event_id string, event_date date, {ID_FOLDER} int").parquet(f"{self.root}/ids/{path}") for path, *_ in entries]
        ids = _fold(DataFrame.union, parts)
        return ids.where(F.col("event_date") >= F.lit(m["ledger_from"][:10]).cast("date")) if m["ledger_from"] else ids

    def _write_ids(self, ids: DataFrame, path: str, level: int) -> list:
        """Writes a run of ids and returns its entry (path, level, folders)."""
        folders = 1 << (max(ids.count() - 1, 0) // self.ids_per_folder).bit_length()  # powers of two, so that few numbers occur
        (ids.select("event_id", "event_date", id_folder(folders).alias(ID_FOLDER)).repartition(ID_FOLDER)
         .write.mode("overwrite").partitionBy(ID_FOLDER).parquet(f"{self.root}/ids/{path}"))
        return [path, level, folders]

    def _append_ids(self, m: dict, ids: DataFrame, version: int) -> list:
        entries, level = self._known(m) + [self._write_ids(ids, f"v={version}", 0)], 0
        while sum(1 for e in entries if e[1] == level) >= self.fanout:
            full = [e for e in entries if e[1] == level]
            entries = [e for e in entries if e[1] != level] + [self._write_ids(self._ids(m, full), f"v={version}-{level + 1}", level + 1)]
            level += 1
        return entries

    def _known(self, m: dict) -> list:
        """The runs of known ids; a store that has a ledger only gets its first run here."""
        if "ids" not in m and (ledger := self.ledger({**m, "ledger_from": None})) is not None:
            m["ids"] = [self._write_ids(ledger, f"v={m['version']}-ledger", 0)]
        return m.setdefault("ids", [])

    def candidates(self, batch: DataFrame, m: dict) -> DataFrame | None:
        """Known ids in the folders that the batch's ids fall into, None without any.

        The batch is read once per number of folders that occurs, so it should be a table.
        """
        parts = []
        for folders in sorted({e[2] for e in self._known(m)}):
            ids = self._ids(m, [e for e in m["ids"] if e[2] == folders])
            if folders > 1:
                met = [r[0] for r in batch.select(id_folder(folders)).distinct().collect()]  # numbers of folders, at most one an id
                ids = ids.where(F.col(ID_FOLDER).isin(met))
            parts.append(ids.select("event_id"))
        return _fold(DataFrame.union, parts) if parts else None

    def fresh(self, batch: DataFrame, m: dict) -> DataFrame:
        """Events whose id is not in the ledger yet, on whatever day.

        Known ids meet only the ids of the batch; what they have in common, the repeats, then leaves the batch.
        """
        dated = batch.withColumn("event_date", F.to_date("occurred_at"))
        ids = self.candidates(batch, m)
        return dated if ids is None else dated.join(ids.join(batch.select("event_id"), "event_id", "left_semi"), "event_id", "left_anti")

    def progress(self, stream: str = "batches") -> int:
        """The highest batch number of a stream that is in the store; -1 before the first."""
        return self.manifest()["streams"].get(stream, -1)

    def merge(self, batch: DataFrame, batch_id: int, stream: str = "batches") -> bool:
        """Adds one batch of valid events to the ledger and all projections, all or nothing; False if it held no new event.

        Batches must come in order of arrival; inside a batch, and in event time, any order gives the same result.
        """
        m = self.manifest()
        version = m["version"] + 1
        path = f"{self.root}/ledger/v={version}"
        spread = F.pmod(F.xxhash64("event_id"), F.lit(16))
        with scratch():
            events = self.fresh(written(dedup_events(batch)), m)
            events.repartition("event_date", spread).write.mode("overwrite").partitionBy("event_date").parquet(path)
        done = {**m, "version": version, "streams": {**m["streams"], stream: max(batch_id, m["streams"].get(stream, -1))}}
        added = any(n.startswith("event_date=") for n in self._names(path))
        if added:
            ledger = self.spark.read.option("basePath", path).parquet(path)  # all folds read what was written
            with scratch():
                tables = {name: self._append(m, name, delta, version) for name, delta in self._deltas(ledger, m).items()}
            done |= {"tables": {**m["tables"], **tables}, "ledger": m["ledger"] + [version], "ids": self._append_ids(m, ledger, version)}
        if added or done["streams"] != m["streams"]:
            self._commit(done)
        return added

    def _deltas(self, ledger: DataFrame, m: dict) -> dict[str, DataFrame]:
        calls = R.call_rows(ledger)
        out = {e.table: R.fold_rows(calls, e) if e is R.LLM else R.fold(ledger, e) for e in R.ENTITIES}
        rows = R.usage_rows(calls)
        updates = R.usage_updates(rows)
        if not updates.isEmpty():
            raises = R.usage_states(R.match_usage_rows(rows, self._earlier_calls(m, updates)))
            out["llm_calls"] = R.merge_states(out["llm_calls"].unionByName(raises, allowMissingColumns=True), R.LLM).select(*R.LLM.columns())
        out["sessions"] = R.fold_sessions(ledger)
        out["instances"] = R.fold_instances(ledger, self._state(m, "instances"))
        out["retry_events"] = R.reduce_retries(ledger)
        out["resource_samples"] = R.reduce_samples(ledger)
        return out

    def _earlier_calls(self, m: dict, updates: DataFrame) -> DataFrame | None:
        """Calls known before the batch in the runs its usage records name, each as one row that precedes the batch."""
        parts = self._parts(m, "llm_calls")
        if parts is None:
            return None
        runs = updates.select("instance_id", "run_id").distinct()
        calls = (parts.select("instance_id", "call_id", F.col("run_id.v").alias("run_id")).join(runs, ["instance_id", "run_id"], "left_semi")
                 .select("instance_id", "call_id").distinct())
        known = merged("llm_calls", parts.join(calls, ["instance_id", "call_id"], "left_semi"))
        return known.select(
            "instance_id", "call_id", F.lit("1970-01-01 00:00:00").cast("timestamp").alias("received_at"), F.lit("").alias("producer_id"),
            F.lit(-1).cast("bigint").alias("sequence"), F.lit("").alias("event_id"),
            *[F.nullif(F.col(c + ".v"), F.lit("")).alias(c) for c in ("run_id", "provider", "model")],
            F.col("started_at.v").alias("start"), F.col("ended_at.v").alias("end"))

    def _append(self, m: dict, name: str, delta: DataFrame, version: int) -> list:
        """Writes a delta and merges full levels; returns the table's new list of (path, level)."""
        delta.write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")
        if name == "instances":  # its fold has taken in the old state
            return [[f"v={version}", 0]]
        entries, level = m["tables"].get(name, []) + [[f"v={version}", 0]], 0
        while sum(1 for _, n in entries if n == level) >= self.fanout:
            full = [e for e in entries if e[1] == level]
            rows = self.spark.read.parquet(*[f"{self.root}/{name}/{path}" for path, _ in full])
            path = f"v={version}-{level + 1}"
            merged(name, rows).write.mode("overwrite").parquet(f"{self.root}/{name}/{path}")
            entries = [e for e in entries if e[1] != level] + [[path, level + 1]]
            level += 1
        return entries

    # --- retention ---------------------------------------------------------------------

    def purge(self, now: str, config: Retention = Retention()) -> dict[str, int]:
        """Deletes expired rows and returns how many per table.

        Ledger days before the cut-off are dropped as directories, the rest of the cut-off day by the manifest;
        a projection with expired rows is written anew without them.
        """
        m = self.manifest()
        version, counts, tables, ledger_from = m["version"] + 1, {}, {}, m["ledger_from"]
        ledger = self.ledger(m)
        if config.events is not None and ledger is not None:
            counts["events"] = ledger.where(expired("occurred_at", config.events, now)).count()
            edge = self.spark.range(1).select((F.lit(now).cast("timestamp") - F.expr(f"interval {config.events} days")).cast("string")).head()[0]
            ledger_from = max(edge, ledger_from or edge)
        limits = {"resource_samples": ("sampled_at", config.samples), **{n: (c, config.projections) for n, c in PROJECTION_TIMES.items()}}
        for name, (time, days) in limits.items():
            state = self._state(m, name)
            if days is None or state is None:
                continue
            gone = finished(name, state).where(expired(time, days, now)).select(*KEYS[name])
            counts[name] = gone.count()
            if counts[name]:
                path = f"v={version}-purged"
                state.join(gone, KEYS[name], "left_anti").write.mode("overwrite").parquet(f"{self.root}/{name}/{path}")
                tables[name] = [[path, max(n for _, n in m["tables"][name])]]
        self._commit({**m, "version": version, "tables": {**m["tables"], **tables}, "ledger_from": ledger_from})
        for v in m["ledger"] if ledger_from else []:
            for n in self._names(f"{self.root}/ledger/v={v}"):
                if n.startswith("event_date=") and n[11:] < ledger_from[:10]:
                    self._fs.delete(self._path(f"{self.root}/ledger/v={v}/{n}"), True)
        return counts
