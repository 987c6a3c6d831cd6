"""Resolution of "not modified" captures against the latest earlier full response of the same address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.lineage import written
from .common import evaluated, salted_join

FULL, NOT_MODIFIED = 200, 304
# Fields that describe the message or the connection, which a 304 must not change in the stored response.
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
               "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Address without scheme, ``www.``, default port, fragment, closing slash and ``utm_`` parameters, parameters in order.

    Host in lower case.  Null stays null; an address without a host is null.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/$", "")
    asked = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&", -1), lambda x: (x != "") & ~x.startswith("utm_")))
    return F.when(host != "", F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def latest_full(events: DataFrame) -> DataFrame:
    """``key, at, record_id`` of each revisit with ``base_id``, the last full response of its ``key`` with a smaller ``at``.

    Rows are dealt by ranges of (key, time), so that a key with very many captures lies in many slices.  In each slice a
    window finds the last full response; what earlier slices of the key end with is carried in, one row per key and slice.
    """
    full = F.col("status") == FULL
    narrow = events.select("key", "at", full.cast("int").alias("kind"), "record_id").distinct()
    order = ["at", "kind", "record_id"]  # at the same time a full response is not earlier than a revisit
    sliced = written(narrow.repartitionByRange("key", *order).withColumn("slice", F.spark_partition_id()))
    base = F.when(F.col("kind") == 1, F.col("record_id"))
    within = W.partitionBy("key", "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = sliced.select("*", F.last(base, ignorenulls=True).over(within).alias("here"))
    ends = sliced.where("kind = 1").groupBy("key", "slice").agg(F.max_by("record_id", F.struct("at", "record_id")).alias("last"))
    spans = sliced.select("key", "slice").distinct().join(ends, ["key", "slice"], "left")
    onward = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select("key", "slice", F.last("last", ignorenulls=True).over(onward).alias("before")).where("before is not null")
    found = local.where("kind = 0").join(carried, ["key", "slice"], "left")
    return found.select("key", "at", "record_id", F.coalesce("here", "before").alias("base_id"))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit of ``records (record_id, url, at, status, headers)`` with its base and merged headers.

    Columns ``record_id, canonical_url, at, base_id, outcome, headers``.  ``outcome`` is ``merged`` if the validators agree,
    entity tags compared weakly, or modification times where the revisit has no tag; ``mismatch`` if they differ or the
    base lacks the one that the revisit has; ``unverified`` if the revisit has none; ``no-base`` without an earlier full
    response or without an address, time or record id.  Header names are compared in lower case; the last of names that
    differ in case only counts.  ``headers`` are the base's with permitted fields of the revisit put over them, and null
    unless merged.  Captures of equal time do not precede one another; of full responses with equal time the larger record
    id counts.  A repeated record id is one response as base; each repeated revisit row is answered.
    """
    usable = F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("record_id").isNotNull()
    lowered = F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    rows = evaluated(records.where(F.col("status").isin(FULL, NOT_MODIFIED)), F.col("record_id"), canonical_url(F.col("url")).alias("key"), F.col("at"), F.col("status"),
                     F.coalesce(lowered, F.array().cast("array<struct<key:string,value:string>>")).alias("e"))
    last_of_name = F.filter("e", lambda x, i: ~F.exists(F.slice("e", i + F.lit(2), F.size("e")), lambda y: y["key"] == x["key"]))
    rows = rows.withColumn("e", last_of_name)
    found = latest_full(rows.where(usable).select("key", "at", "status", "record_id"))
    revisits = rows.where(F.col("status") == NOT_MODIFIED).join(found, ["key", "at", "record_id"], "left")
    bases = rows.where((F.col("status") == FULL) & usable).groupBy(F.col("record_id").alias("base_id")).agg(F.max(F.struct("at", F.sort_array("e").alias("e"))).alias("b"))
    known = salted_join(revisits.where("base_id is not null"), bases, "base_id", "record_id")
    own, base = F.map_from_entries("e"), F.map_from_entries("b.e")
    tag, time = own["etag"], own["last-modified"]
    agreed = F.when(tag.isNotNull(), _weak(tag) == _weak(base["etag"])).otherwise(F.trim(time) == F.trim(base["last-modified"]))
    outcome = F.when(tag.isNull() & time.isNull(), "unverified").when(F.coalesce(agreed, F.lit(False)), "merged").otherwise("mismatch")
    permitted = F.map_filter(own, lambda k, _: ~k.isin(KEPT_FIELDS))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(permitted, k)), permitted)
    answered = known.select("record_id", F.col("key").alias("canonical_url"), "at", "base_id", outcome.alias("outcome"), merged.alias("headers"))
    answered = answered.withColumn("headers", F.when(F.col("outcome") == "merged", F.col("headers")))
    alone = revisits.where("base_id is null").select("record_id", F.col("key").alias("canonical_url"), "at", "base_id", F.lit("no-base").alias("outcome"),
                                                     F.lit(None).cast("map<string,string>").alias("headers"))
    return answered.union(alone)
