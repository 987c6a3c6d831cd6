"""From raw documents to packed training sequences, in five stages.

Every stage gets what its predecessor kept, with the columns of ``documents``, and its output is written as Parquet and
read again before the next one.  The last stage gives the packed sequences with their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlake.functions.lineage import written
from spanlake.llm.common import table
from spanlake.llm.line_dedup import line_dedup
from spanlake.llm.mixing import mixture
from spanlake.llm.near_dedup import NearDedup, deduplicated
from spanlake.llm.packing import packed
from spanlake.llm.quality_classifier import good_documents

#: Near copies share five-word shingles with a similarity of 0.8 or more; 30 bands miss such a pair with probability 7e-6.
NEAR = NearDedup(percent=80, bands=30)

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return good_documents(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one that was nothing else stays with an empty text."""
    freed = line_dedup(docs)
    return freed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies."""
    return deduplicated(docs, NEAR).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixture(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with bucket, batch, slot and text."""
    return packed(docs, with_text=True)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near_copies), ("source_mixing", mix), ("packing", pack)]

#: A trained classifier and hash-based stages cannot be said in SQL; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
