"""Exact copies by a tree merge of sorted digest runs.

Each input partition is a run of digests.  In a round, ``fan`` neighbouring runs become one: rows of a digest meet, the id
that stays and the number of rows are kept, and the new run is written sorted.  After log(runs) / log(fan) rounds one run
is left.  A task combines the rows it holds before they move, so a digest with a third of all rows sends one row per task
in the first round and at most ``fan`` rows into any group later.

Digests move without texts.  What one run holds once is done: the row is its own group.  Texts of digests with several
rows then go through the same rounds, grouped by digest and text, so that at every level the ids of two runs are joined
only where the texts agree byte by byte, and equal digests of different texts stay apart.  Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import released, written
from .common import rows_of, salted_join, spread_join


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Merge:
    """``runs`` bounds the runs at the start, ``fan`` of them are merged at once; ``largest`` says which id stays."""

    runs: int = 512
    fan: int = 8
    largest: bool = True
    digest: Callable[[Column], Column] = sha256

    def __post_init__(self) -> None:
        if self.runs < 1 or self.fan < 2:
            raise ValueError("a merge needs a run at least and joins two or more at once")


def tree_merge(rows: DataFrame, keys: list[str], m: Merge) -> DataFrame:
    """Rows ``run, *keys, id, n`` as one row per ``keys`` with the id that stays and the sum of ``n``.

    Each round's runs are a table in the shared folder, so a lost executor costs a round at most.
    """
    best, runs, level = F.max if m.largest else F.min, m.runs, rows
    while level is rows or runs > 1:
        runs = -(-runs // m.fan)
        merged = (level.groupBy(F.floor(F.col("run") / m.fan).alias("run"), *keys)
                  .agg(best("id").alias("id"), F.sum("n").alias("n")).sortWithinPartitions("run", keys[0]))
        after = written(merged)
        if level is not rows:
            released(level)
        level = after
    return level.drop("run")


def exact_groups(docs: DataFrame, m: Merge = Merge(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``keep_id`` of its group, ``group_size`` (long), ``kept`` and the text's ``digest``.

    Texts are one group when they have the same bytes; a null text counts as empty.  A null id is kept only in a group
    without another id.  Rows that repeat an id and its text count each and share the verdict.  Other columns are not
    read, and an empty table gives an empty one.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.pmod(F.spark_partition_id(), F.lit(m.runs)).alias("run"), m.digest(whole).alias("digest"), F.col(f"`{id}`").alias("id"), whole.alias("text"))
    counted = tree_merge(rows.select("run", "digest", "id", F.lit(1).cast("bigint").alias("n")), ["digest"], m)
    alone = counted.where("n = 1").select("id", F.col("id").alias("keep_id"), F.col("n").alias("group_size"), "digest")
    several = counted.where("n > 1").select("digest")
    held = written(spread_join(rows, several, "digest", "id"))
    groups = tree_merge(held.withColumn("n", F.lit(1).cast("bigint")), ["digest", "text"], m)
    named = groups.select("digest", F.col("text").alias("_text"), F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    copies = salted_join(held, named, "digest", "id").where("text = _text").select("id", "keep_id", "group_size", "digest")
    return alone.unionByName(copies).select(F.col("id").alias(id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def exact_deduplicated(docs: DataFrame, m: Merge = Merge(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of ``docs``, with all its columns, that stays of each group; of rows that repeat id and text, one."""
    stay = exact_groups(docs, m, id, text).where("kept").select(F.col(f"`{id}`").alias("_id"), F.col("digest").alias("_digest")).distinct()
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id}`").alias("_own"), m.digest(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_digest"))
    found = named.join(stay, (named["_digest"] == stay["_digest"]) & named["_own"].eqNullSafe(stay["_id"]), "left_semi")
    return rows_of(found.withColumn("_text", F.coalesce(F.col("_row")[text], F.lit(""))).dropDuplicates(["_own", "_text"]))
