"""Exact rank quantiles of large groups without sorting any group in one task.

Ranks are narrowed bin by bin.  Rows are counted per group and coarse value bin (a monotone function of the value, a few
thousand bins at most) with the least and greatest value of the bin, and the bin that holds each rank is found.  A bin of
one value gives the answer; wider ones are split again into parts of equal ratio between their own least and greatest
value, for the wanted bins of all groups at once, until every rank stands in a bin of one value.  A split leaves the
thousandth part, so a few rounds do for any doubles and one or two for whole numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .lineage import written

FLOOR = "floor"      # rank = int((n - 1) * q) + 1
NEAREST = "nearest"  # rank = max(1, ceil(n * q))


def value_bin(value: Column) -> Column:
    """Non-decreasing in the value; 64 bins per doubling of its size."""
    size = F.floor(F.log2(F.abs(value) + F.lit(1.0)) * 64) + 1
    return F.when(value < 0, -size).when(value == 0, 0).otherwise(size).cast("int")


SPLITS = 1 << 12  # parts of a bin that is split again
BIN = ["_lo", "_hi"]


def _counted(rows: DataFrame, by: list[str], part: str) -> DataFrame:
    """Rows, missing rows, least and greatest value per part; a missing value ranks before the value it stands for."""
    return rows.groupBy(*by, part).agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col("_set"), 0).otherwise(F.col("_n"))).alias("_gone"),
                                       F.min("_v").alias("_least"), F.max("_v").alias("_most"))


def _holding(asked: DataFrame, keys: list[str]) -> DataFrame:
    """Of parts with a wanted rank ``_rank`` and the rows up to their end ``_cum``: those that hold it, as a table."""
    inside = asked.where("_rank > _cum - _n and _rank <= _cum")
    return written(inside.select(*keys, "_bin", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_gone", "name",
                                 (F.col("_rank") - F.col("_cum") + F.col("_n")).alias("_rank")))


def _part() -> Column:
    """Part of ``_v`` between ``_lo`` and ``_hi``, non-decreasing; both ends fall into different parts.  No bin holds zero and another value."""
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    near, far = F.when(lo > 0, lo).otherwise(hi), F.when(lo > 0, hi).otherwise(lo)
    ratio = F.when(far / near > 1.0000001, F.log(v / near) / F.log(F.greatest(far / near, F.lit(1.0000001)))).otherwise((v - near) / (far - near))
    at = F.greatest(F.lit(0), F.least(F.lit(SPLITS - 1), F.floor(ratio * SPLITS))).cast("int")
    return F.when(lo > 0, at).otherwise(F.lit(SPLITS - 1) - at)


def _upto(by: list[str], part: str) -> Column:
    return F.sum("_n").over(W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_cum")


def rank_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                   rule: str = FLOOR, weight: str | None = None) -> DataFrame:
    """One row per key with the value at each quantile's rank.

    A missing value ranks as zero (before real zeros) and is returned as missing.  Keys must not be null.  ``df`` is read
    once per round, so it should be a table.
    """
    rows = df.select(*keys, F.coalesce(F.col(value), F.lit(0.0)).alias("_v"), F.col(value).isNotNull().alias("_set"),
                     (F.col(weight) if weight else F.lit(1).cast("bigint")).alias("_n"))
    rows = rows.withColumn("_bin", value_bin(F.col("_v")))
    total = F.sum("_n").over(W.partitionBy(*keys)).cast("double")
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"),
                 (F.floor((total - 1) * F.lit(q)) + 1 if rule == FLOOR
                  else F.greatest(F.lit(1), F.ceil(total * F.lit(q)))).cast("bigint").alias("_rank"))
        for name, q in quantiles.items()])
    bins = _counted(rows, keys, "_bin").select("*", _upto(keys, "_bin"), wanted.alias("_ranks"))
    found = [_holding(bins.select("*", F.inline("_ranks")), keys)]
    by = [*keys, "_bin", *BIN]
    while not (wide := found[-1].where("_lo < _hi").drop("_gone")).isEmpty():
        parts = rows.join(wide.select(*by).distinct(), [*keys, "_bin"]).where("_v between _lo and _hi").withColumn("_part", _part())
        found.append(_holding(_counted(parts, by, "_part").select("*", _upto(by, "_part")).join(wide, by).drop(*BIN), keys))
    picked = reduce(DataFrame.unionByName, found).where("_lo = _hi").withColumn("_v", F.when(F.col("_rank") > F.col("_gone"), F.col("_lo")))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in quantiles])
