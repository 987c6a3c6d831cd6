"""Registered queries over the given tables, one per operator, with statements where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.lineage import application_folder, written
from .common import WORD, evaluated, table
from .embedding_dedup import near_vectors
from .exact_dedup import exact_groups
from .line_dedup import passage_dedup
from .mixing import mixed
from .near_dedup import near_duplicates
from .packing import packed
from .personal_data import personal_data
from .periodic_runs import periodic_runs
from .perplexity import quality_rules
from .quality_classifier import quality_scores
from .revisits import FULL, NOT_MODIFIED, canonical_url, resolve
from .spelling_variants import variant_groups
from .token_rollup import TokenTotals, token_counts

TOKENIZER_VERSIONS = ["byte_bpe_50k", "words"]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of several lines."""
    return passage_dedup(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Web captures made from ``pages``: the page id is the time, each third page is a "not modified" revisit.

    Full responses carry an entity tag of their address and of a version that changes every 4000 pages, or a modification
    time; revisits carry those of their own time, and some neither.
    """
    address, version = canonical_url(F.col("url")), F.floor(F.col("page_id") / 4000).cast("string")
    revisit = F.col("page_id") % 3 == 2
    tag = F.concat(F.when(F.col("page_id") % 2 == 0, "W/").otherwise(""), F.md5(F.concat_ws("|", address, version)))
    fields = F.array(F.struct(F.lit("ETag").alias("key"), F.when(F.col("page_id") % 7 < 5, tag).alias("value")),
                     F.struct(F.lit("Last-Modified").alias("key"), F.when(F.col("page_id") % 7 < 6, version).alias("value")),
                     F.struct(F.lit("Date").alias("key"), F.col("page_id").cast("string").alias("value")),
                     F.struct(F.lit("Content-Length").alias("key"), F.when(revisit, "0").otherwise(F.length("html").cast("string")).alias("value")))
    headers = F.map_from_entries(F.filter(fields, lambda f: f["value"].isNotNull()))
    return pages.select(F.col("page_id").alias("record_id"), "url", F.col("page_id").alias("at"), F.when(revisit, NOT_MODIFIED).otherwise(FULL).alias("status"), headers.alias("headers"))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(table(spark, sf_dir, "pages")))
    fields = [F.col("headers")[k].alias(k.replace("-", "_")) for k in ("etag", "last-modified", "date", "content-length")]
    return found.select("record_id", "canonical_url", "at", "base_id", "outcome", *fields)


REVISITS = r"""
WITH parts AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
split AS (SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS asked FROM parts),
named AS (SELECT page_id, html, CASE WHEN host <> '' THEN host || path || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS url FROM split),
captures AS (SELECT page_id AS id, url, page_id % 3 = 2 AS revisit, CAST(page_id // 4000 AS VARCHAR) AS version,
    CASE WHEN page_id % 7 < 5 THEN md5(concat_ws('|', url, CAST(page_id // 4000 AS VARCHAR))) END AS tag, page_id % 2 = 0 AS weak,
    CASE WHEN page_id % 7 < 6 THEN CAST(page_id // 4000 AS VARCHAR) END AS modified, CAST(length(html) AS VARCHAR) AS size FROM named),
paired AS (SELECT r.*, f.id AS base_id, f.tag AS base_tag, f.weak AS base_weak, f.modified AS base_modified, f.size AS base_size
    FROM (SELECT * FROM captures WHERE revisit) r ASOF LEFT JOIN (SELECT * FROM captures WHERE NOT revisit) f ON r.url = f.url AND r.id > f.id),
judged AS (SELECT *, CASE WHEN base_id IS NULL THEN 'no-base' WHEN tag IS NULL AND modified IS NULL THEN 'unverified'
    WHEN COALESCE(CASE WHEN tag IS NOT NULL THEN tag = base_tag ELSE modified = base_modified END, FALSE) THEN 'merged' ELSE 'mismatch' END AS outcome FROM paired)
SELECT id AS record_id, url AS canonical_url, id AS "at", base_id, outcome,
    CASE WHEN outcome = 'merged' THEN COALESCE(CASE WHEN weak THEN 'W/' ELSE '' END || tag, CASE WHEN base_weak THEN 'W/' ELSE '' END || base_tag) END AS etag,
    CASE WHEN outcome = 'merged' THEN COALESCE(modified, base_modified) END AS last_modified,
    CASE WHEN outcome = 'merged' THEN CAST(id AS VARCHAR) END AS date,
    CASE WHEN outcome = 'merged' THEN base_size END AS content_length
FROM judged"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches of changes to all documents; the second is delivered twice.

    All documents come in, each twentieth is deleted, and another twentieth is revised to nine tenths of its tokens.
    """
    counts = written(token_counts(table(spark, sf_dir, "documents"), TOKENIZER_VERSIONS))
    group = ["source", "lang", "tokenizer"]
    come = counts.select(F.lit("insert").alias("kind"), *group, "tokens", F.lit(None).cast("bigint").alias("old_tokens"))
    go = counts.where("doc_id % 20 = 7").select(F.lit("delete").alias("kind"), *group, F.lit(None).cast("bigint").alias("tokens"), F.col("tokens").alias("old_tokens"))
    other = counts.where("doc_id % 20 = 3").select(F.lit("revise").alias("kind"), *group, (F.col("tokens") - F.floor(F.col("tokens") / 10)).alias("tokens"), F.col("tokens").alias("old_tokens"))
    rollup = TokenTotals(spark, f"{application_folder(spark)}/totals-{uuid.uuid4().hex}")
    for name, changes in (("come", come), ("go", go), ("go", go), ("other", other)):
        rollup.apply(name, changes)
    return rollup.totals()


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def with_periodic_parts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the documents, by checksum of the id, repeats some of its words from a place on to the end."""
    sum_ = F.crc32(F.col("doc_id").cast("string"))
    chosen = evaluated(docs, F.col("doc_id"), F.col("text"), F.floor(sum_ / 10).alias("g"),
                       F.when(sum_ % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    n, g = F.size("w"), F.col("g")
    begin = g % n
    period = F.lit(1) + F.floor((n - begin) / (F.lit(3) + g % 8))
    placed = evaluated(chosen.where("size(w) > 0"), F.col("doc_id"), F.col("w"), begin.cast("int").alias("a"), period.cast("int").alias("p"))
    repeated = F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))).otherwise(x))
    return chosen.where("coalesce(size(w), 0) < 1").select("doc_id", "text").union(placed.select("doc_id", F.array_join(repeated, " ")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periodic_parts(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("_l", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_l.start")).alias("start"), F.col("_l.length").alias("length"), (-F.col("_l.period")).alias("period"),
        F.expr("(1000 * _l.length) div -_l.period").alias("exponent_milli"), F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


EXACT_COPIES = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
copies AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size, sha256(text) AS text_sha256 FROM texts GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM texts JOIN copies USING (text)"""

LETTERS = "[A-Za-z\u00C0-\u00FF]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LONG_WORD = 7  # code points


def words_with_lost_letters(docs: DataFrame) -> DataFrame:
    """``word, n`` of runs of letters of seven code points or more that occur twice at least; some occurrences, by checksum, lose a letter."""
    asked = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{LONG_WORD},}}"), F.lit(0))).alias("x"))
    small = F.when(F.lower("x") == F.col("x"), F.col("x")).otherwise(F.translate("x", UPPER, UPPER.lower()))
    summed = evaluated(asked, small.alias("x"), F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), small)).alias("h"))
    at = (F.col("h") % F.length("x")).cast("int")
    lost = F.concat(F.substring("x", F.lit(1), at), F.substring("x", at + F.lit(2), F.length("x")))
    words = summed.select(F.when(F.col("h") % 31 == 0, lost).otherwise(F.col("x")).alias("word"))
    return words.where(F.length("word") >= LONG_WORD).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(words_with_lost_letters(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_revisits, op4_quality_classifier, op5_source_mix, op6_personal_data, op7_near_duplicates,
                                   op8_token_rollup, op9_near_vectors, op10_length_buckets, op11_periodic_runs, op12_exact_copies, op13_spelling_variants)}
ORACLES = {"op3_revisits": REVISITS.strip(), "op12_exact_copies": EXACT_COPIES.strip()}
