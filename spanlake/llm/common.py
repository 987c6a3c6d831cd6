"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

WORD = r"[^\x20\x09-\x0D]+"  # a word: no ASCII blank, tab or line break in it
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_row(df: DataFrame, *named: str) -> DataFrame:
    """The whole row as ``_row`` beside the ``named`` columns, so that no other column can clash with added ones."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *named)


def rows_of(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def evaluated(df: DataFrame, *columns: Column) -> DataFrame:
    """``df.select(*columns)``, computed here once and not again wherever a later expression uses them."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def words(text: object) -> list[bytes]:
    """Words of one text as UTF-8; bytes.split() cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def salted_join(big: DataFrame, small: DataFrame, key: str, by: str, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """``big.join(small, key)`` where a few keys may hold most rows of ``big`` and each key has one row in ``small``.

    Rows of a key are dealt over ``salts`` tasks by ``by``.  A row of ``small`` is repeated only for the salts that its key uses.
    """
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    used = dealt.select(key, "_salt").distinct()
    return dealt.join(small.join(used, key), [key, "_salt"], how).drop("_salt")


def spread_join(big: DataFrame, small: DataFrame, key: str, by: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """As ``salted_join`` for a ``small`` of a few numbers in a row, which is repeated for every salt.

    That saves two shuffles.  Both sides are shuffled for the join only, so Spark can split what is still large.
    """
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return dealt.join(repeated, [key, "_salt"], how).drop("_salt")


def columns_of(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The named columns only, so that other columns of the input cannot clash with those an operator adds."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def map_texts(df: DataFrame, passed: list[str], made: dict[str, str], fn: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """The ``passed`` columns unchanged, and columns ``made`` (name and type) that ``fn`` computes from the texts of an Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(c) for c in passed] + fn(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(arrays, [*passed, *names])

    names = list(made)
    schema = T.StructType([*df.select(*passed).schema.fields, *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in made.items()]])
    return columns_of(df, dict.fromkeys([*passed, "text"])).mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], schema: str, fn: Callable[[pd.DataFrame], pd.DataFrame | None]) -> DataFrame:
    """Applies ``fn`` to the rows of each group; for very many small groups of bounded size with integer keys.

    Rows are clustered by sorting, so that groups cost a slice each and not a call between processes.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if len(rows):
                held.append(rows)
                rows = pd.concat(held, ignore_index=True) if len(held) > 1 else rows
                k = rows[keys].to_numpy()
                ends = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
                if not len(ends):
                    continue  # one group so far, which may go on
                held = [rows.iloc[ends[-1]:]]
                yield from results(rows, [0, *ends])
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield from results(rows, [0, len(rows)])

    def results(rows: pd.DataFrame, cuts: list[int]) -> Iterator[pd.DataFrame]:
        made = [x for a, b in zip(cuts, cuts[1:]) if (x := fn(rows.iloc[a:b])) is not None]
        if made:
            yield pd.concat(made, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
