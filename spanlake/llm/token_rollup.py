"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes is reduced to one signed row per group and written into a folder of its own; a total is the sum of the
committed batches.  A batch is committed when Spark's writer has put its success marker there, and a batch id that is
committed already is not applied again, so a batch may be delivered any number of times and a failed attempt leaves
nothing behind that counts.  Totals never read documents again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_texts, words

GROUP = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"
TOKENIZERS = "/opt/tokenizers"


@cache
def bpe(folder: str, name: str) -> Callable[[list[str]], list[int]]:
    """Token counts by a byte-level vocabulary of ``folder`` (ranks, one base64 token and its rank per line)."""
    import tiktoken
    lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    # fixed pattern of this family of vocabularies: contractions, letters, digits, other marks, white space
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]


def token_counts(docs: DataFrame, tokenizers: Iterable[str], folder: str = TOKENIZERS, passed: Iterable[str] = ("doc_id", "source", "lang")) -> DataFrame:
    """One row per document and tokenizer version: the passed columns, ``tokenizer`` and ``tokens`` (0 for null or empty).

    A version is the name of a vocabulary in ``folder``, or ``words``.
    """
    names = list(tokenizers)

    def count(texts: list[str | None]) -> list[pa.Array]:
        made = [[len(words(t)) for t in texts] if name == "words" else bpe(folder, name)(texts) for name in names]
        return [pa.array([list(row) for row in zip(*made)], pa.list_(pa.int64()))]

    counted = map_texts(docs, list(passed), {"counts": "array<bigint>"}, count)
    pairs = F.arrays_zip(F.array(*map(F.lit, names)).alias("tokenizer"), F.col("counts").alias("tokens"))
    return counted.select(*passed, F.inline(pairs))


def signed(changes: DataFrame) -> DataFrame:
    """Changes ``kind, source, lang, tokenizer, tokens, old_tokens`` as one additive row per group.

    An insert adds a document and its tokens, a delete takes both away, a revision adds the difference of the counts.
    Null counts are 0, another kind changes nothing, null names form groups of their own.
    """
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    one = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).otherwise(0)
    by = F.when(F.col("kind") == "insert", new).when(F.col("kind") == "delete", -old).when(F.col("kind") == "revise", new - old).otherwise(0)
    return changes.groupBy(*GROUP).agg(F.sum(one).cast("bigint").alias("documents"), F.sum(by).cast("bigint").alias("tokens"))


class TokenTotals:
    """The rollup in ``folder``, which every executor can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        where, files = self._files(f"{self.folder}/batch={batch}/_SUCCESS")
        return files.exists(where)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch once; False if that id was committed before.  What a failed attempt left is overwritten."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        if self.committed(batch):
            return False
        signed(changes).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` over all committed batches; groups that came back to zero go."""
        where, files = self._files(self.folder)
        folders = [str(f.getPath()) for f in files.listStatus(where)] if files.exists(where) else []
        done = [f for f in folders if self.committed(f.rpartition("=")[2])]
        rows = self.spark.read.schema(TOTALS).parquet(*done) if done else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

