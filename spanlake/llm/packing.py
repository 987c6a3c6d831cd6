"""Length buckets that pad least, and token-budget batches inside each.

Texts longer than ``longest`` are cut into pieces between words, so the histogram of lengths over the whole corpus has at
most ``longest`` entries, whatever the corpus.  Dynamic programming over it finds the bucket boundaries whose padding is
smallest; the cost of a bucket is linear in its boundary, so each layer is a lower envelope of lines.  A batch of a bucket
holds as many sequences as the token budget allows at the bucket's boundary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import written
from .common import WORD, map_texts
from .mixing import running_start


@dataclass(frozen=True)
class Packing:
    longest: int = 4096     # words in a sequence
    buckets: int = 16
    budget: int = 65_536    # words in a batch, padding included
    range_bits: int = 12    # hash ranges in which a bucket's sequences are ranked
    seed: int = 10


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper boundaries, at most ``buckets`` of them, with the least total padding; lengths ascend and are distinct.

    ``cost(i, j) = L_j * (C_j - C_i) - (T_j - T_i)`` pads lengths i+1..j to L_j, with C and T the running counts and words.
    Per layer the best i minimises a line of slope -C_i at L_j; slopes fall and the points rise, so both ends move on only.
    """
    n = len(lengths)
    if not n:
        return []
    c, t = [0], [0]
    for length, count in zip(lengths, counts):
        c.append(c[-1] + count)
        t.append(t[-1] + count * length)
    best, choice = [0] + [None] * n, []
    for _ in range(min(buckets, n)):
        lines: list[tuple[int, int, int]] = []  # slope, value at 0, index; the lower envelope from left to right
        head, layer, came = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                slope, value = -c[j - 1], best[j - 1] + t[j - 1]
                while len(lines) - head >= 2 and (value - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - slope):
                    lines.pop()
                lines.append((slope, value, j - 1))
            x = lengths[j - 1]
            while len(lines) - head >= 2 and lines[head + 1][0] * x + lines[head + 1][1] <= lines[head][0] * x + lines[head][1]:
                head += 1
            if head < len(lines):
                slope, value, i = lines[head]
                layer[j], came[j] = slope * x + value + x * c[j] - t[j], i
        choice.append(came)
        best = layer
    ends, j = [], n
    for came in reversed(choice):
        ends.append(lengths[j - 1])
        j = came[j]
    return ends[::-1]


def pieces(docs: DataFrame, passed: list[str], longest: int) -> DataFrame:
    """The passed columns and ``piece, begin, end, length``: code points begin..end of the text hold ``length`` words.

    A text within ``longest`` words is one piece from 0 to its end, white space included; longer ones are cut before a
    word.  Null texts and texts without words have no piece.
    """
    word = re.compile(WORD)

    def cut(texts: list[str | None]) -> list[pa.Array]:
        out = []
        for text in texts:
            # bytes.split() counts words faster than the pattern finds them; only long texts need the places
            n = len(text.encode("utf-8", "surrogatepass").split()) if text else 0
            if n > longest:
                starts = [m.start() for k, m in enumerate(word.finditer(text)) if k % longest == 0]
                ends = [*starts[1:], len(text)]
                starts[0] = 0
                out.append([{"piece": k, "begin": b, "end": e, "length": min(longest, n - k * longest)} for k, (b, e) in enumerate(zip(starts, ends))])
            else:
                out.append([{"piece": 0, "begin": 0, "end": len(text), "length": n}] if n else [])
        kind = pa.struct([("piece", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("length", pa.int64())])
        return [pa.array(out, pa.list_(kind))]

    return map_texts(docs, passed, {"p": "array<struct<piece:bigint,begin:bigint,end:bigint,length:bigint>>"}, cut).select(*passed, F.inline("p"))


def packed(docs: DataFrame, p: Packing = Packing(), with_text: bool = False) -> DataFrame:
    """``doc_id, piece, begin, end, length, bucket, padded, batch, slot`` per sequence of ``docs (doc_id, text, ...)``.

    ``with_text`` adds the sequence's text.  ``bucket`` counts from 0 by boundary, ``padded`` is the boundary, ``batch`` counts from 0 in the bucket and ``slot``
    in the batch.  Sequences stand in the order of a hash of id and place, equal ones in any order.  Texts without words
    give no sequence; repeated rows are rows of their own; other columns are ignored; no input gives no sequence.
    """
    carried = ["text"] if with_text else []
    cut = pieces(docs, ["doc_id", *carried], p.longest)
    if with_text:
        cut = cut.withColumn("text", F.expr("substring(text, cast(begin + 1 as int), cast(end - begin as int))"))
    rows = written(cut.withColumn("place", F.xxhash64(F.lit(p.seed), "doc_id", "piece", "end")))
    histogram = sorted((r["length"], r["count"]) for r in rows.groupBy("length").count().collect())  # at most ``longest`` rows
    ends = optimal_boundaries([x for x, _ in histogram], [n for _, n in histogram], p.buckets) or [p.longest]
    bounds = F.array(*[F.lit(e).cast("bigint") for e in ends])
    bucket = F.size(F.filter(bounds, lambda e: e < F.col("length")))
    placed = rows.withColumn("bucket", bucket).withColumn("one", F.lit(1).cast("bigint"))
    ranked = running_start(placed, ["bucket"], F.shiftright("place", 64 - p.range_bits), ["place", "doc_id", "piece", "begin", "end"], "one", "rank")
    ranked = ranked.withColumn("padded", F.get(bounds, F.col("bucket"))).withColumn("room", F.greatest(F.lit(1), F.floor(F.lit(p.budget) / F.col("padded"))))
    return ranked.select("doc_id", "piece", "begin", "end", "length", "bucket", "padded", F.floor(F.col("rank") / F.col("room")).alias("batch"), (F.col("rank") % F.col("room")).alias("slot"), *carried)
