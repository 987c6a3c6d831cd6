"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``near`` most similar reference vectors (pivots), nearest first.  Every pivot has an inverted
list of the vectors that name it.  Two vectors that share at least ``shared`` pivots are candidates, and each candidate
pair is verified by its cosine in double precision in the list of the smallest pivot that both name, hence once.  Lists are
compared in blocks of bounded size as matrix products; a block returns a link count per vector and a spanning forest of
its links, never its pairs.  Exact copies are one vector with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import written
from .common import salted_join, spread_join
from .components import components


@dataclass(frozen=True)
class PivotIndex:
    cosine: float = 0.9
    near: int = 12            # pivots that describe a vector
    shared: int = 3           # pivots that a candidate pair shares at least
    per_root: float = 2.0     # pivots for each root of the number of vectors, which balances both steps' work
    most: int = 65_536        # pivots are a sample of at most this many vectors, and are sent to all tasks
    least: int = 64
    block: int = 1024         # vectors of a list compared with as many others at once
    seed: int = 9


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` where no component is null or not finite and not all are zero.

    Single-precision components stay so, which halves what is sent; all sums are made in double precision.
    """
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector")).where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _unit(rows: list, width: int) -> np.ndarray:
    """Matrix of unit vectors; shorter ones end in zeros.  Scaling first keeps very large and very small ones exact."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def pivots(classes: DataFrame, p: PivotIndex) -> np.ndarray:
    """The reference vectors: those of smallest hash, a documented sample whose size grows with the root of the input."""
    n = classes.count()
    wanted = int(min(p.most, max(p.least, p.per_root * n ** 0.5)))
    rows = classes.select("vector", F.xxhash64(F.lit(p.seed), "id").alias("h"), "id").orderBy("h", "id").limit(wanted).select("vector").collect()
    rows = [list(r["vector"]) for r in rows]
    return _unit(rows, max(map(len, rows), default=1))


def described(classes: DataFrame, reference: np.ndarray, p: PivotIndex) -> DataFrame:
    """``id, weight, vector`` with ``pivots``, the numbers of the nearest reference vectors, nearest first."""
    sent = classes.sparkSession.sparkContext.broadcast(reference)
    near = min(p.near, len(reference))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = part.column("vector").to_pylist()
                ref = sent.value
                width = max(ref.shape[1], max(map(len, rows)))
                unit = _unit(rows, width)
                close = -(unit[:, :ref.shape[1]] @ ref.T)
                first = np.argpartition(close, near - 1, axis=1)[:, :near]
                order = np.take_along_axis(first, np.lexsort((first, np.take_along_axis(close, first, 1)), axis=1), 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], [*part.schema.names, "pivots"])

    return classes.select("id", "weight", "vector").mapInArrow(describe, f"id bigint, weight bigint, vector {dict(classes.dtypes)['vector']}, pivots array<int>")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (vertex, smallest vertex of its group) of the graph with links a-b over 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return [(i, int(x)) for i, x in enumerate(label) if x != i]
        label = after


def links(index: DataFrame, p: PivotIndex) -> DataFrame:
    """``id, n, other``: parts of link counts (weights of linked vectors) and a spanning forest, per compared block."""
    listed = index.withColumn("pivot", F.explode("pivots"))
    sizes = listed.groupBy("pivot").agg(F.count("*").alias("n")).where("n > 1")
    placed = spread_join(listed, sizes, "pivot", "id").withColumn("blocks", F.ceil(F.col("n") / F.lit(p.block)))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "weight", "vector", F.array_sort("pivots").alias("pivots"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mine", "id"])
        pivot, i, j = int(rows["pivot"].iat[0]), rows["i"].iat[0], rows["j"].iat[0]
        ids, weight, mine = rows["id"].to_numpy(), rows["weight"].to_numpy(), rows["mine"].to_numpy()
        names = list(rows["pivots"])
        known, flat = np.unique(np.concatenate(names), return_inverse=True)
        holds = np.zeros((len(rows), len(known)), np.float32)
        holds[np.repeat(np.arange(len(rows)), [len(x) for x in names]), flat] = 1
        before = holds[:, :np.searchsorted(known, pivot)]
        unit = _unit(list(rows["vector"]), max(map(len, rows["vector"])))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        pairs = (before[left] @ before[right].T == 0) & (holds[left] @ holds[right].T >= p.shared)
        if i == j:
            pairs = np.triu(pairs, 1)
        x, y = np.nonzero(pairs & (unit[left] @ unit[right].T >= p.cosine - 1e-9))
        a, b = left[x], right[y]
        exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= p.cosine
        a, b = a[exact], b[exact]
        n = np.bincount(a, weight[b], len(rows)) + np.bincount(b, weight[a], len(rows))
        other = np.full(len(rows), -1)
        for v, root in _forest(len(rows), a, b):
            other[v] = root
        hit = np.flatnonzero(n)
        return pd.DataFrame({"id": ids[hit], "n": n[hit].astype(np.int64), "other": np.where(other[hit] < 0, ids[hit], ids[other[hit]])})

    return dealt.groupBy("pivot", "i", "j").applyInPandas(compare, "id bigint, n bigint, other bigint")


def near_vectors(vectors: DataFrame, p: PivotIndex = PivotIndex()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors (vec_id, embedding, ...)``.

    A vector that is null, empty, zero or holds a null or non-finite component, or that has no id, links with nothing.
    Vectors of different length are compared as if the shorter ended in zeros.  A repeated row
    links with its copies like any other; rows of one id with different vectors count their links together.  No input
    gives no rows.
    """
    good = written(usable(vectors))
    classes = written(good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    reference = pivots(classes, p)
    if not len(reference):
        return vectors.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    p = replace(p, shared=min(p.shared, p.near, len(reference)))  # no vector names more pivots than there are
    parts = written(links(described(classes, reference, p), p))
    counts = parts.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(parts, "id", "other")
    named = classes.join(counts, "id", "left").join(groups, "id", "left")
    named = named.select("vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component_id", "id").alias("c"))
    found = salted_join(good, named, "vector", "vec_id").select("vec_id", "n", "c")
    rest = vectors.select("vec_id").exceptAll(good.select("vec_id"))
    every = found.union(rest.select("vec_id", F.lit(0).cast("bigint"), F.col("vec_id")))
    return every.select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("c"), F.lit(True)).alias("kept"))
