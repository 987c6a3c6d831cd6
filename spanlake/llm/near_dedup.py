"""MinHash near-duplicates with sequential Bayesian verification.

Every text is tokenised once: its distinct word shingles give a count, band keys for the candidate search and a
signature of 16-bit minima.  Texts with the same words are one class.  Candidates of a band bucket are compared
batch by batch of the signature; a pair goes on while the posterior probability that its similarity reaches the
threshold stays above the miss probability.  What survives is compared on full shingle sets.

Groups of copies may be large, so no bucket is expanded into its pairs.  First every member meets only the smallest
member of each of its buckets.  Buckets whose members are then all connected are done.  In the others, blocks of
bounded size are compared in memory, only between members not connected yet and of compatible size, first by signature
and, for members that are in a surviving pair, on full shingle sets.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import released, written
from .common import as_row, map_groups, map_texts, rows_of, salted_join, spread_join, words
from .components import components


@dataclass(frozen=True)
class NearDedup:
    percent: int = 85          # link at 100 * intersection >= percent * union
    shingle: int = 5           # words in a shingle
    bands: int = 20            # a pair at the threshold misses every band with probability 8e-6
    rows: int = 5
    batch: int = 32            # signature entries looked at in one step
    batches: int = 4
    miss: float = 1e-6         # posterior below which a candidate is dropped
    block: int = 500           # members of a bucket compared at once with as many others

    @property
    def hashes(self) -> int:
        return max(self.batch * self.batches, self.bands * self.rows)


@cache
def _coefficients(n: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_000 + shift)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


@cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lowered(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.lower() changes no other letter."""
    return [w.lower() for w in words(text)]


def shingle_set(tokens: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; the whole sequence as one where there are fewer than k words."""
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(tokens), seed=1)], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n, mult = len(w) - k + 1, _multipliers(k)
    s = w[:n] * mult[0]
    for i in range(1, k):
        s += w[i:n + i] * mult[i]
    return np.unique(s ^ (s >> np.uint64(29)))


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    x = ((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    a, b = _coefficients(n, 0)
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 2048):
        grid = a[:, None] * x[None, at:at + 2048]
        grid += b[:, None]
        np.minimum(out, grid.min(axis=1), out=out)
    return out


@cache
def least_matches(p: NearDedup) -> tuple[int, ...]:
    """Fewest equal entries after each batch that keep P(similarity >= threshold | matches) at ``miss`` or above.

    With a uniform prior the posterior is a Beta distribution, whose tail is a binomial sum.
    """
    t, out = p.percent / 100, []
    for seen in range(p.batch, p.batch * p.batches + 1, p.batch):
        below, m = 0.0, 0
        while m <= seen and (below := below + comb(seen + 1, m) * t ** m * (1 - t) ** (seen + 1 - m)) < p.miss:
            m += 1
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, p: NearDedup) -> np.ndarray:
    """Equal signature entries of each pair of rows, -1 where a batch showed the pair to be too unlike."""
    matches = np.zeros(len(a), np.int32)
    alive = np.arange(len(a))
    for i, least in enumerate(least_matches(p)):
        cut = slice(i * p.batch, (i + 1) * p.batch)
        matches[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1, dtype=np.int32)
        gone = matches[alive] < least
        matches[alive[gone]] = -1
        alive = alive[~gone]
    return matches


def _matrix(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(len(signatures), -1)


def similar(a: str, b: str, p: NearDedup) -> bool:
    x, y = (shingle_set(lowered(t), p.shingle) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= p.percent * (len(x) + len(y) - both)


def signatures(docs: DataFrame, p: NearDedup) -> DataFrame:
    """``doc_id, n_shingles, class, bands, signature`` per row; the last three are null without words."""
    def sign(texts: list[str | None]) -> list[pa.Array]:
        n, classes, keys, sigs = [], [], [], []
        for text in texts:
            tokens = lowered(text)
            s = shingle_set(tokens, p.shingle)
            n.append(len(s))
            if len(s):
                m = minima(s, p.hashes)
                classes.append(hashlib.blake2b(b" ".join(tokens), digest_size=16).digest())
                keys.append([xxhash.xxh3_64_intdigest(m[i * p.rows:(i + 1) * p.rows].tobytes(), seed=i) - (1 << 63) for i in range(p.bands)])
                sigs.append(m[:p.batch * p.batches].astype(np.uint16).tobytes())
            else:
                for made in (classes, keys, sigs):
                    made.append(None)
        return [pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]

    return map_texts(docs, ["doc_id"], {"n_shingles": "bigint", "class": "binary", "bands": "array<bigint>", "signature": "binary"}, sign)


def _posterior(p: NearDedup):
    @F.pandas_udf("int")
    def matches(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(survivors(_matrix(a), _matrix(b), p), dtype="int32") if len(a) else pd.Series([], dtype="int32")
    return matches


def _exact(p: NearDedup):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y, p) for x, y in zip(a, b)], dtype="bool")
    return linked


def _both(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Adds ``value`` of a and b (as ``a_value`` and ``b_value``); b may be the same in very many pairs."""
    first = pairs.join(rows.select(F.col("id").alias("a"), F.col(value).alias("a_value")), "a")
    return salted_join(first, rows.select(F.col("id").alias("b"), F.col(value).alias("b_value")), "b", "a", salts=256)


def _verified(pairs: DataFrame, pool: DataFrame, p: NearDedup) -> DataFrame:
    """Pairs of ids that reach the threshold on full shingle sets."""
    return _both(pairs.select("a", "b"), pool, "text").where(_exact(p)("a_value", "b_value")).select("a", "b").distinct()


def _pairs(rows: pd.DataFrame, p: NearDedup) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a block that survive the signatures.

    Only members of blocks i and j are paired that are not connected yet, have compatible sizes, and share no earlier band.
    A member of size class c meets classes c and c + 1, as others cannot reach the threshold.
    """
    sig, bands = _matrix(rows["signature"]), np.array(rows["bands"].tolist())
    mine, comp, c, n = (rows[x].to_numpy() for x in ("mine", "comp", "c", "n_shingles"))
    key, g, i, j = (rows[x].iat[0] for x in ("key", "g", "i", "j"))
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    fits = (comp[left, None] != comp[right]) & ((c[left, None] == g) | (c[right] == g))
    fits &= 100 * np.minimum(n[left, None], n[right]) >= p.percent * np.maximum(n[left, None], n[right])
    if i == j:
        fits &= left[:, None] < right
    x, y = np.nonzero(fits)
    band = int(np.flatnonzero(bands[0] == key)[0])
    found = []
    for at in range(0, len(x), 50_000):
        a, b = left[x[at:at + 50_000]], right[y[at:at + 50_000]]
        first = ~(bands[a, :band] == bands[b, :band]).any(axis=1)
        a, b = a[first], b[first]
        alive = survivors(sig[a], sig[b], p) >= 0
        found.append((a[alive], b[alive]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, int) for k in (0, 1))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with one another, from products of their incidence matrix by parts."""
    shingles, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(at, minlength=len(shingles)) > 1
    place = np.cumsum(often) - 1
    row, at = row[often[at]], place[at[often[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(often.sum()), 4096):
        part = slice(*np.searchsorted(at, [lo, lo + 4096]))
        holds = np.zeros((len(sets), 4096), np.float32)
        holds[row[part], at[part] - lo] = 1
        out += holds @ holds.T
    return out.astype(np.int64)


BLOCK = "key bigint, g bigint, i bigint, j bigint, mine bigint, id bigint, comp bigint, c bigint, n_shingles bigint, bands array<bigint>, signature binary"


def _open_links(members: DataFrame, pool: DataFrame, p: NearDedup) -> DataFrame:
    """Links among the not yet connected ``members (key, id, comp, n_shingles, bands, signature)`` of every bucket."""
    step = float(np.log(100 / p.percent))
    counted = members.withColumn("c", F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(step)))
    sides = counted.withColumn("g", F.explode(F.array(F.col("c"), F.col("c") - 1)))
    sizes = sides.groupBy("key", "g").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    placed = spread_join(sides.withColumn("kg", F.struct("key", "g")), sizes.select(F.struct("key", "g").alias("kg"), "n"), "kg", "id")
    placed = placed.withColumn("blocks", F.ceil(F.col("n") / F.lit(p.block))).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).select("key", "g", "i", "j", "mine", "id", "comp", "c", "n_shingles", "bands", "signature")

    def open_rows(rows: pd.DataFrame) -> pd.DataFrame | None:
        x, y = _pairs(rows, p) if len(rows) > 1 else ((), ())
        return rows.iloc[np.unique(np.concatenate([x, y]))] if len(x) else None

    def exact(rows: pd.DataFrame) -> pd.DataFrame | None:
        x, y = _pairs(rows, p) if len(rows) > 1 else ((), ())
        if not len(x):
            return None
        sets = [shingle_set(lowered(t), p.shingle) for t in rows["text"]]
        size, both, ids = np.array([len(s) for s in sets]), _common(sets)[x, y], rows["id"].to_numpy()
        hit = 100 * both >= p.percent * (size[x] + size[y] - both)
        return pd.DataFrame({"a": np.maximum(ids[x], ids[y])[hit], "b": np.minimum(ids[x], ids[y])[hit]})

    block = ["key", "g", "i", "j"]
    asked = map_groups(dealt, block, BLOCK, open_rows)
    return map_groups(asked.join(pool, "id"), block, "a bigint, b bigint", exact).distinct()


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups (id, component_id)`` after more links between ids have been found."""
    comp = groups.withColumnRenamed("component_id", "comp")
    ends = links.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
    merged = components(ends.select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "ca", "cb").select(F.col("id").alias("comp"), "component_id")
    ids = comp.union(merged.select(F.col("comp").alias("id"), "comp").join(comp, "id", "left_anti"))
    return written(spread_join(ids, merged, "comp", "id", how="left").select("id", F.coalesce("component_id", "comp").alias("component_id")))


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text, ...)``.

    A text that is null, empty or only white space has no shingles and is linked with nothing.  Rows of one doc_id are
    one document.  A row without a doc_id takes part in no link: its component is null and it is kept.  Other columns are
    ignored.  An empty input gives an empty result.
    """
    rows = written(signatures(docs, p))
    linkable = rows.where("class is not null and doc_id is not null")
    classes = written(linkable.groupBy("class").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"),
                                                    F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    buckets = classes.select("id", F.explode("bands").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    others = written(spread_join(buckets, heads, "key", "id").where("id > b"))  # members without the first of their bucket
    stars = others.select(F.col("id").alias("a"), "b").distinct()
    scored = written(_both(stars, classes, "signature").select("a", "b", _posterior(p)("a_value", "b_value").alias("matches")).where("matches >= 0"))
    asked = others.select("id").union(others.select("b")).distinct()
    pool = written(docs.select(F.col("doc_id").alias("id"), "text").join(asked, "id", "left_semi"))

    best = scored.groupBy("a").agg(F.max(F.struct("matches", (-F.col("b")).alias("first"))).alias("m")).select("a", (-F.col("m.first")).alias("b"))
    first = written(best)
    joined = written(components(_verified(first, pool, p), "a", "b"))
    comp = joined.withColumnRenamed("component_id", "comp")
    apart = scored.join(first, ["a", "b"], "left_anti").join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left")
    apart = apart.join(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")
    labelled = others.where("n > 2").select("key", "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    members = spread_join(labelled, mixed, "key", "id").join(classes.select("id", "n_shingles", "bands", "signature"), "id")
    rest = written(_verified(apart, pool, p).union(_open_links(members, pool, p)))
    if not rest.isEmpty():
        joined = _merged(joined, rest)
    released(first, rest, others, scored, pool)

    named = classes.select("class", "id").join(joined, "id", "left").select("class", F.coalesce("component_id", "id").alias("component_id"))
    by_row = spread_join(linkable.select("doc_id", "n_shingles", "class"), named, "class", "doc_id").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("class is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return by_row.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """Rows of ``docs`` whose document is the first of its group, with their columns; rows that repeat a doc_id stay
    once, rows without one all stay."""
    gone = near_duplicates(docs, p).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = as_row(docs, "doc_id").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    nameless = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return rows_of(left.withColumn("_number", nameless).dropDuplicates(["doc_id", "_number"]))
