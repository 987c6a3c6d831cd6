"""Evaluating expensive columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evaluated(df: DataFrame, *columns: Column) -> DataFrame:
    """``df.select(*columns)`` whose columns later filters use as values.

    A filter on a column that parses text would otherwise be pushed below the projection with the
    whole expression in it, once per use.  A one-row generator keeps the filter above.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def evaluated_in_steps(df: DataFrame, kept: list[str], made: dict[str, Column], step: int = 6) -> DataFrame:
    """The ``kept`` columns and those of ``made``, a few evaluated at a time.

    The code of one step stays short enough for the JVM's compiler, which leaves methods of more than 8000 bytes
    interpreted; thirty columns out of one payload are several times faster in steps.
    """
    left = list(made)
    done: list[str] = []
    while left:
        now, left = left[:step], left[step:]
        needed = df.columns if left else kept
        df = evaluated(df, *[F.col(c) for c in dict.fromkeys([*needed, *done])], *[made[c].alias(c) for c in now])
        done += now
    return df.select(*kept, *made)
