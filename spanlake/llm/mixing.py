"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is cut into blocks of its own size, equal up to a word and no larger than a common limit, and has as many slots
as its target needs blocks; the last of them takes only the words that are left.  So every source ends at its target in
whole words, however small it is beside the others.  Slots 0, 1, 2, ... step through all places by nearly the golden ratio of their number, each
place once, and the places through the cumulative numbers of slots to sources, so any run of slots holds every source in
nearly its share.  The n-th slot of a source takes the n-th block of the source's documents, which stand in an order
shuffled by hash; after the last block the next pass over the source begins.  Ranks of slots and places of documents are
running counts over hash or slot ranges, so no source is ordered in one task however many rows it has.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.lineage import written
from .common import WORD, as_row, rows_of, word_count

GOLDEN = (5 ** 0.5 - 1) / 2


def step(n: int) -> int:
    """A step near ``n`` golden ratios that visits all of ``n`` places, of those around it one that spreads them most evenly.

    The quotients of the continued fraction of step / n bound how far the count of any interval departs from its share.
    """
    def unevenness(g: int) -> int:
        a, b, total = n, g, 0
        while b:
            total, a, b = total + a // b, b, a % b
        return total

    middle = round(n * GOLDEN)
    near = [g for g in range(max(1, middle - 500), middle + 501) if gcd(g, n) == 1]
    return min(near, key=lambda g: (unevenness(g), abs(g - middle), g))


@dataclass(frozen=True)
class Mix:
    share: float = 1.5                 # words taken, as a multiple of all words
    weights: tuple[int, ...] = (3, 1, 2)  # of sources in code point order, repeating
    most: int = 2                      # passes over a source at most
    slots: int = 1 << 21               # about so many slots, until blocks have reached their largest size
    smallest: int = 16                 # words in a block
    largest: int = 4096                # words in a block at most; a source has blocks of its own size below this
    range_bits: int = 12               # 2 ** range_bits hash ranges in which a source's documents are ordered
    run: int = 1 << 14                 # slots in which a source's slots are ranked at once
    cells: int = 1 << 16               # cells of [0, 1) in which a point looks for its source, at most
    seed: int = 20


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``source_key, source_size, target`` of ``sizes (source_key, source_size)``: shares by weight, cut at ``most`` passes.

    Cutting the sources in the order of size / weight makes one pass enough: after the first source that is not cut,
    no other is.  One row per source meets in a window here, never a document.
    """
    rank = F.row_number().over(W.orderBy(F.col("source_key").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (rank % len(mix.weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * mix.most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source_key").asc_nulls_last())
    upto, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    filled = ranked.withColumn("left", F.lit(mix.share) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    level = filled.withColumn("level", F.col("left") / F.sum("weight").over(onward)).withColumn("cut", F.col("level") * F.col("weight") >= F.col("cap"))
    first = level.withColumn("final", F.min(F.when(~F.col("cut"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(W.partitionBy())["level"])
    return first.select("source_key", "source_size", F.when(F.col("cut") | F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def running_start(df: DataFrame, keys: list[str], cut: Column, order: list[str], amount: str, into: str) -> DataFrame:
    """Sum of ``amount`` over the rows of ``keys`` before each row, where ``cut`` does not decrease along ``order``."""
    rows = df.withColumn("_cut", cut)
    inside = W.partitionBy(*keys, "_cut").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_cut").agg(F.sum(amount).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_cut", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("bigint")).alias("_from"))
    local = rows.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0).cast("bigint")))
    return local.join(offsets, [*keys, "_cut"]).withColumn(into, F.col("_from") + F.col("_in")).drop("_cut", "_in", "_from")


def sized(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame, int]:
    """Rows ``doc_id, source_key, size, place``, source targets, and the block size.

    ``source_key`` is the source behind a mark, so that the missing source is a key like others and the last.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))
    rows = written(docs.select("doc_id", key.alias("source_key"), word_count(F.col("text")).alias("size")).withColumn("place", F.xxhash64(F.lit(mix.seed), "doc_id", "size")))
    goals = written(targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), mix))
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    return rows, goals, int(min(max(total / mix.slots, mix.smallest), mix.largest))


def _cut(goals: DataFrame, block: int) -> DataFrame:
    """``goals`` with the source's number of ``blocks``, ``wide`` of them of ``least + 1`` words and the others of ``least``,
    the words ``due`` and the number of ``slots``.

    The first blocks are the wide ones.
    """
    due = F.round("target").cast("bigint")
    cut = goals.withColumn("blocks", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("source_size") / F.lit(block)))).withColumn("due", due)
    cut = cut.withColumn("least", F.expr("source_size div blocks")).withColumn("wide", F.col("source_size") % F.col("blocks"))
    rest = F.col("due") % F.col("source_size")
    return cut.withColumn("slots", F.when(F.col("due") > 0, F.expr("due div source_size") * F.col("blocks") + F.when(rest > 0, _block_of(rest - 1) + 1).otherwise(0)).otherwise(0).cast("bigint"))


def _block_of(word: Column) -> Column:
    wide = F.col("wide") * (F.col("least") + 1)
    return F.when(word < wide, F.floor(word / (F.col("least") + 1))).otherwise(F.col("wide") + F.floor((word - wide) / F.col("least"))).cast("bigint")


def _first_word(block: Column) -> Column:
    return block * F.col("least") + F.least(block, F.col("wide"))


def schedule(goals: DataFrame, block: int, mix: Mix = Mix()) -> DataFrame:
    """``slot, source_key, turn, block, words``: which block of which source each slot takes, ``turn`` counting passes from 0.

    ``words`` are taken from the start of the block; only the last slot of a source can take less than its block.
    """
    before = F.coalesce(F.sum("slots").over(W.orderBy("source_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    shares = _cut(goals, block).where("slots > 0").withColumn("lo", before).withColumn("hi", F.col("lo") + F.col("slots"))
    found = shares.agg(F.sum("slots"), F.count("*")).first()
    total, sources = int(found[0] or 0), int(found[1])
    # Cells of equal width tell the few sources that a place can belong to, whatever the number of sources.
    cells = max(1, min(mix.cells, sources * 16, total))
    cell = lambda x: F.floor(x * F.lit(cells) / F.lit(max(total, 1)))
    names = ["source_key", "source_size", "blocks", "least", "wide", "due"]
    ends = shares.select(*names, "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    place = F.col("slot") * F.lit(step(total) if total > 1 else 1) % F.lit(max(total, 1))
    points = goals.sparkSession.range(total).withColumnRenamed("id", "slot").withColumn("place", place)
    hits = points.withColumn("cell", cell(F.col("place"))).join(ends, "cell").where("place >= lo and place < hi").select("slot", *names)
    ranked = running_start(hits.withColumn("one", F.lit(1).cast("bigint")), ["source_key"], F.floor(F.col("slot") / F.lit(mix.run)), ["slot"], "one", "rank")
    out = ranked.withColumn("turn", F.expr("rank div blocks")).withColumn("block", F.col("rank") % F.col("blocks"))
    left = F.col("due") - F.col("turn") * F.col("source_size") - _first_word(F.col("block"))
    length = F.col("least") + (F.col("block") < F.col("wide")).cast("bigint")
    return out.select("slot", "source_key", "turn", "block", F.least(left, length).alias("words"))


def blocks(rows: DataFrame, goals: DataFrame, block: int, mix: Mix = Mix()) -> DataFrame:
    """``source_key, block, doc_id, size, start, first, words``: the pieces of documents that each block holds, ``first`` their
    place in the block and ``start`` the document's in the source.

    Documents stand in the order of a hash of their id and size, equal ones in any order; empty ones are in no block.
    """
    cut = F.shiftright("place", 64 - mix.range_bits)
    placed = running_start(rows.where("size > 0"), ["source_key"], cut, ["place", "doc_id", "size"], "size", "start")
    placed = placed.join(_cut(goals, block).select("source_key", "blocks", "least", "wide"), "source_key")
    end = F.col("start") + F.col("size")
    each = placed.withColumn("block", F.explode(F.sequence(_block_of(F.col("start")), _block_of(end - 1))))
    each = each.withColumn("from", _first_word(F.col("block"))).withColumn("to", _first_word(F.col("block") + 1))
    begin = F.greatest("start", "from")
    return each.select("source_key", "block", "doc_id", "size", "start", (begin - F.col("from")).alias("first"), (F.least(end, "to") - begin).alias("words"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row of ``docs (doc_id, text, source, ...)``.

    ``taken`` are the words of the row that the schedule takes, passes counted.  A null text has size 0; documents of
    size 0 are taken 0 times; rows without a source are a source of their own, after the others.  Repeated rows are rows
    of their own.  Other columns are ignored.  An empty input gives an empty result.
    """
    rows, goals, block = sized(docs, mix)
    uses = schedule(goals, block, mix).groupBy("source_key", "block").agg(F.collect_list("words").alias("uses"))  # one per pass
    pieces = blocks(rows, goals, block, mix).join(uses, ["source_key", "block"], "left")
    part = lambda a, w: a + F.greatest(F.lit(0).cast("bigint"), F.least("words", w - F.col("first")))
    times = F.aggregate(F.coalesce("uses", F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), part)
    taken = pieces.groupBy("source_key", "start", "doc_id", "size").agg(F.sum(times).alias("taken"))
    every = taken.select("source_key", "doc_id", "size", "taken").union(rows.where("size = 0").select("source_key", "doc_id", "size", F.lit(0).cast("bigint")))
    return every.join(goals, "source_key").select("doc_id", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them: ``taken / size`` rounded to whole documents, columns unchanged.

    Rounding goes by a hash of the document, so that the words of a source of many documents stay near its target.  Empty
    texts are not taken.
    """
    times = mixed(docs, mix).where("size > 0").groupBy("doc_id").agg(F.max(F.col("taken") / F.col("size")).alias("_times"))
    threshold = F.pmod(F.xxhash64(F.lit(mix.seed + 1), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(F.col("_times") + threshold).cast("int")
    chosen = times.select(F.col("doc_id").alias("_doc"), copies.alias("_copies")).where("_copies > 0")
    joined = as_row(docs.where(F.rlike("text", F.lit(WORD))), "doc_id").join(chosen, F.col("doc_id").eqNullSafe(F.col("_doc")))
    return rows_of(joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))))
