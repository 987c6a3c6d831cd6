"""Running values along an ordered key without putting a whole key in one task.

A key's rows are cut into slices along their order.  Inside a slice a window runs as
usual; per slice one summary row is kept, the summaries are carried forward, and each
slice joins the value carried into it.  A hot key is thus spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOUR = 3600
SEQUENCE_SLICE = 1 << 20


def time_slice(column: str, seconds: int = HOUR) -> Column:
    return F.floor(F.unix_micros(column) / F.lit(seconds * 1000000.0))


def running(df: DataFrame, keys: list[str], order: list[str], slice_by: Column,
            values: dict[str, tuple[str, Column]], before: bool = False, backwards: bool = False, late: dict[str, Column] | None = None) -> DataFrame:
    """Adds running columns: ``{name: (kind, expr)}`` with kind ``last``, ``sum``, ``max`` or ``min``.

    ``last`` is the newest non-null value so far; ``before`` leaves the current row out;
    ``backwards`` runs from the end of the order to its start; ``late`` columns, which ``order`` may name,
    are made after the shuffle by slice.
    The slice must not decrease along ``order``; keys and slice must not be null.
    """
    cut = "_slice"
    df = df.withColumn(cut, slice_by)
    for name, (_, expr) in values.items():
        df = df.withColumn("_x_" + name, expr)
    local = df.repartition(*keys, cut).withColumns(late) if late else df
    df = df.withColumns(late or {})
    turn = (lambda c: F.col(c).desc()) if backwards else F.col
    within = W.partitionBy(*keys, cut).orderBy(*[turn(c) for c in order]).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    onward = W.partitionBy(*keys).orderBy(turn(cut)).rowsBetween(W.unboundedPreceding, -1)
    position = F.struct(*order)
    folds = {
        "last": (lambda c: F.last(c, ignorenulls=True), lambda c: (F.min_by if backwards else F.max_by)(c, F.when(c.isNotNull(), position))),
        "sum": (F.sum, F.sum), "max": (F.max, F.max), "min": (F.min, F.min),
    }
    summary = df.groupBy(*keys, cut).agg(*[folds[kind][1](F.col("_x_" + n)).alias("_s_" + n) for n, (kind, _) in values.items()])
    carried = summary.select(*keys, cut, *[folds[kind][0](F.col("_s_" + n)).over(onward).alias("_c_" + n) for n, (kind, _) in values.items()])
    for n, (kind, _) in values.items():
        local = local.withColumn("_l_" + n, folds[kind][0](F.col("_x_" + n)).over(within))
    out = local.join(carried, [*keys, cut])
    for n, (kind, _) in values.items():
        here, earlier = F.col("_l_" + n), F.col("_c_" + n)
        out = out.withColumn(n, {
            "last": F.coalesce(here, earlier),
            "sum": F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0)),
            "max": F.greatest(here, earlier), "min": F.least(here, earlier),
        }[kind])
    return out.drop(cut, *["_x_" + n for n in values], *["_l_" + n for n in values], *["_c_" + n for n in values])


def previous(df: DataFrame, keys: list[str], order: list[str], slice_by: Column, columns: dict[str, str],
             backwards: bool = False) -> DataFrame:
    """Adds the previous (or next) row's value of each column (``{new: old}``), null on a key's first (last) row."""
    df = running(df, keys, order, slice_by,
                 {"_prev": ("last", F.struct(*[F.col(old).alias(new) for new, old in columns.items()]))}, before=True, backwards=backwards)
    for new in columns:
        df = df.withColumn(new, F.col("_prev." + new))
    return df.drop("_prev")


def volume_slices(df: DataFrame, keys: list[str], time: str, rows: int, name: str) -> DataFrame:
    """Adds the number of a slice of about ``rows`` rows along ``time`` (a timestamp) of each key, whatever the hours hold.

    Rows are counted per second, the counts are summed along a key's seconds, and a second belongs to the slice its first
    row falls into; a slice exceeds ``rows`` only by what its last second holds.
    """
    second = F.floor(F.unix_micros(time) / F.lit(1000000.0)).alias("_second")
    counts = df.groupBy(*keys, second).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_second").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    cuts = counts.select(*keys, "_second", F.floor(before / F.lit(rows)).cast("bigint").alias(name))
    return df.withColumn("_second", second).join(cuts, [*keys, "_second"]).drop("_second")
