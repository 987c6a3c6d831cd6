"""Usage records that name a run but no call, matched with the run's newest call at their arrival.

Events of calls and records of one run are read together in order of arrival.  A run of up to ``largest`` rows is one
group.  A larger run is cut along its arrival into slices of about so many rows, and each slice gets the state it starts
with: calls that have events in the slice come in as they stood before, and of all others, which do not change inside the
slice, only the best one per question matters.  A call's state stands for a stretch of slices between two of its events;
such stretches are split into blocks of power-of-two lengths, the best call of each block is a plain maximum, and a slice
looks at the few blocks above it.  No record is compared with the calls of its run one by one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.frames import plain_columns
from ..functions.lineage import written
from ..functions.ordered import volume_slices
from ..functions.text import packed, unpacked
from ..schemas import ARRIVAL

RUN = ["instance_id", "home"]
LARGEST = 1 << 18    # rows of a run that one task may hold
CHUNK = 1 << 16      # rows of whole groups that are read at once
NEVER = -(1 << 62)   # a time before all others
LEVELS = 24          # a run has up to 2^24 slices
EVENT, RECORD, BEST = 0, 1, 2
FIELDS = ("run_id", "provider", "model")
GROUPED = ("kind", "call_id", "home", *FIELDS, "start", "end")


def _group(rows: dict[str, list], first: int, last: int) -> tuple[list[int], list[str]]:
    """(places of matched records, their calls) of the group that ``rows`` hold from ``first`` to ``last``, in order of arrival.

    Per question (provider and model, empty for any) a heap has the calls by newest time and id; an entry counts while
    the call still stands as it did when the entry was made.
    """
    kind, calls, home_of, run_of, providers, models, starts, ends = [rows[c][first:last] for c in GROUPED]
    asked = {(p, m) for k, p, m in zip(kind, providers, models) if k == RECORD}
    if not asked:
        return [], []
    rank = {c: -i for i, c in enumerate(sorted({c for c in calls if c is not None}))}
    name = {r: c for c, r in rank.items()}
    heaps: dict[tuple[str, str], list] = {q: [] for q in asked}
    state: dict[str, list] = {}
    places, found = [], []
    for at, (k, call, home, run, provider, model, start, end) in enumerate(zip(kind, calls, home_of, run_of, providers, models, starts, ends), first):
        if k == RECORD:
            heap = heaps[provider, model]
            while heap and heap[0][2] is not None and state[name[heap[0][1]]][5] != heap[0][2]:
                heapq.heappop(heap)
            if heap:
                places.append(at)
                found.append(name[heap[0][1]])
        elif k == BEST:
            if (provider, model) in heaps:
                heapq.heappush(heaps[provider, model], (-start, rank[call], None))
        else:
            s = state.setdefault(call, [None, "", "", NEVER, NEVER, 0])
            s[0], s[1], s[2] = run or s[0], provider or s[1], model or s[2]
            s[3] = start if s[3] == NEVER else s[3]
            s[4] = end if end != NEVER else s[4]
            s[5] += 1
            if s[0] == home:
                newest = s[4] if s[4] != NEVER else s[3]
                for p, m in asked:
                    if p in ("", s[1]) and m in ("", s[2]):
                        heapq.heappush(heaps[p, m], (-newest, rank[call], s[5]))
    return places, found


def _matched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matches of whole groups, which lie together; only the last group of what was read may go on."""
    keys = [*RUN, "cut"]

    def solved(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        places, found = [], []
        lists = {c: rows[c].tolist() for c in GROUPED}  # once for all groups, most of which have a few rows
        for a, b in zip(cuts, cuts[1:]):
            at, calls = _group(lists, a, b)
            places += at
            found += calls
        return plain_columns(rows.iloc[places][["instance_id", "event_id", "home", "raise"]].assign(call_id=np.array(found, dtype=object)))

    held: list[pd.DataFrame] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= CHUNK:
            rows = pd.concat(held, ignore_index=True)
            ends = np.flatnonzero(rows[keys].ne(rows[keys].shift()).any(axis=1).to_numpy())
            yield solved(rows, ends.tolist())
            held, size = [rows.iloc[ends[-1]:]], 0  # a group alone is looked at again after another chunk
    if held:
        rows = pd.concat(held, ignore_index=True)
        if len(rows):
            yield solved(rows, [*np.flatnonzero(rows[keys].ne(rows[keys].shift()).any(axis=1).to_numpy()).tolist(), len(rows)])


def _blocks(first: Column, last: Column) -> Column:
    """Blocks ``(level, at)`` of power-of-two lengths that make up the slices from ``first`` to ``last``, two a level at most."""
    def inside(level: Column, at: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("bigint")
        return (at * size >= first) & ((at + 1) * size - 1 <= last)

    def of(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("bigint")
        ends = F.array_distinct(F.array(F.ceil(first / size).cast("bigint"), F.floor((last + 1) / size).cast("bigint") - 1))
        return F.transform(F.filter(ends, lambda at: inside(level, at) & ~inside(level + 1, F.floor(at / 2).cast("bigint"))),
                           lambda at: F.struct(level.alias("level"), at.alias("at")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of))


def _carried(sliced: DataFrame) -> DataFrame:
    """What slices of large runs start with, as rows before all others of the slice."""
    events = sliced.where(F.col("kind") == EVENT)
    order = F.struct(*ARRIVAL)
    given = lambda c: F.col(c) != NEVER
    call = [*RUN, "call_id"]
    touched = events.groupBy(*call, "cut").agg(
        *[F.max_by(c, F.when(F.col(c) != "", order)).alias(c) for c in FIELDS],
        F.min_by("start", F.when(given("start"), order)).alias("start"), F.max_by("end", F.when(given("end"), order)).alias("end"))
    w = W.partitionBy(*call).orderBy("cut")

    def upto(end: int) -> list[Column]:
        span = w.rowsBetween(W.unboundedPreceding, end)
        return [*[F.last(c, True).over(span).alias(c) for c in (*FIELDS, "end")], F.first("start", True).over(span).alias("start")]

    def row(df: DataFrame, kind: int, **columns: Column) -> DataFrame:
        """With the columns of ``sliced``; the empty arrival precedes every other."""
        empty = {"received_at": F.lit("1970-01-01 00:00:00").cast("timestamp"), "producer_id": F.lit(""), "sequence": F.lit(kind - 10).cast("bigint"), "event_id": F.lit("")}
        made = {"kind": F.lit(kind), **empty, **columns}
        return df.select(*[made[f.name].alias(f.name) if f.name in made else F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in sliced.schema.fields])

    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in FIELDS} | {c: F.coalesce(F.col(c), F.lit(NEVER)) for c in ("start", "end")}
    before = touched.select(*call, "cut", *upto(-1), F.lag("cut").over(w).alias("_before")).where("_before is not null")
    after = touched.select(*call, *upto(0), (F.col("cut") + 1).alias("_first"), (F.coalesce(F.lead("cut").over(w), F.lit(1 << LEVELS)) - 1).alias("_last"))
    stands = after.where((F.col("run_id") == F.col("home")) & (F.col("_first") <= F.col("_last"))).select(
        *RUN, "call_id", F.coalesce("provider", F.lit("")).alias("_p"), F.coalesce("model", F.lit("")).alias("_m"),
        F.coalesce("end", "start", F.lit(NEVER)).alias("newest"), F.inline(_blocks(F.col("_first"), F.col("_last"))))
    questions = sliced.where(F.col("kind") == RECORD).select(*RUN, "provider", "model", "cut").distinct()
    views = F.array(*[F.struct((F.col("_p") if p else F.lit("")).alias("provider"), (F.col("_m") if m else F.lit("")).alias("model")) for p in (0, 1) for m in (0, 1)])
    best = (stands.select(*RUN, "call_id", "newest", "level", "at", F.inline(F.array_distinct(views)))
            .groupBy(*RUN, "provider", "model", "level", "at").agg(F.max(F.struct("newest", "call_id")).alias("b")))
    above = questions.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")).withColumn("at", F.floor(F.col("cut") / F.pow(F.lit(2.0), F.col("level"))).cast("bigint"))
    top = above.join(best, [*RUN, "provider", "model", "level", "at"]).groupBy(*RUN, "provider", "model", "cut").agg(F.max("b").alias("b"))
    return row(before, EVENT, **blank).unionByName(row(top, BEST, call_id=F.col("b.call_id"), run_id=F.lit(""), start=F.col("b.newest"), end=F.lit(NEVER)))


def newest_calls(events: DataFrame, records: DataFrame, largest: int = LARGEST) -> DataFrame:
    """``instance_id, event_id, run_id, raise, call_id``: each record with the call it raises; records without one are left out.

    ``events``: instance_id, call_id, arrival, run_id, provider, model (null or empty where not given), start, end.
    ``records``: instance_id, arrival, run_id, provider, model (empty for any), raise.
    A call is its run's as long as its last given run says so; its time is its last end, else its first start, and of
    equal times the greatest id counts.
    """
    runs = records.select("instance_id", F.col("run_id").alias("home")).distinct()
    homes = (events.where("run_id <> ''").select("instance_id", F.col("run_id").alias("home"), "call_id")
             .join(runs, RUN, "left_semi").distinct())
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in FIELDS]
    time = [F.coalesce(F.unix_micros(c), F.lit(NEVER)).alias(c) for c in ("start", "end")]
    nothing = F.lit(None).cast(records.schema["raise"].dataType).alias("raise")
    # most events are of calls that no record can mean; their ids travel as bytes to that join
    met = events.withColumn("event_id", packed(F.col("event_id"))).join(homes, ["instance_id", "call_id"]).withColumn("event_id", unpacked(F.col("event_id")))
    mine = met.select(F.lit(EVENT).alias("kind"), *RUN, "call_id", *ARRIVAL, *text, *time, nothing)
    asked = records.select(F.lit(RECORD).alias("kind"), "instance_id", F.col("run_id").alias("home"), F.lit(None).cast("string").alias("call_id"), *ARRIVAL, *text,
                           F.lit(NEVER).alias("start"), F.lit(NEVER).alias("end"), "raise")
    rows = written(mine.unionByName(asked))
    big = rows.groupBy(*RUN).count().where(F.col("count") > largest).select(*RUN)
    whole = rows.withColumn("cut", F.lit(0).cast("bigint"))
    if not big.isEmpty():
        sliced = written(volume_slices(rows.join(big, RUN, "left_semi"), RUN, "received_at", largest, "cut"))
        whole = whole.join(big, RUN, "left_anti").unionByName(sliced).unionByName(_carried(sliced))
    matched = whole.withColumn("raise", F.to_json("raise")).repartition(*RUN, "cut").sortWithinPartitions(*RUN, "cut", *ARRIVAL).mapInPandas(
        _matched, "instance_id string, event_id string, home string, raise string, call_id string")
    back = F.from_json("raise", records.schema["raise"].dataType.simpleString())
    return matched.select("instance_id", "event_id", F.col("home").alias("run_id"), back.alias("raise"), "call_id")
