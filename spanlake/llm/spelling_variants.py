"""Groups of spelling variants through a reduced alphabet.

Letters are hashed to a few symbols, which makes a reduced word of every word.  Words one edit apart have reduced words at
most one edit apart, so the full one-edit neighbourhood of every reduced word, itself included, is generated and joined
with the reduced vocabulary, and the pairs of words behind it are verified on their letters.  A neighbourhood has about
2 * symbols * length members whatever the alphabet.  Two neighbouring reduced words are in each other's neighbourhood, so a
member goes into the join only from the one with the smaller code.

A reduced word is represented by a polynomial hash of its symbols, and the hash of every edit follows from those of the
word's beginnings and endings, so a word of n letters costs n numbers and not n strings.  Hashes that agree by chance cost
a verification and nothing else.  The number of symbols grows with the eighth root of the vocabulary, so that a reduced
word stands for few words at any size.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import released, written

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LONG = 64  # code points beyond which words are not given to the built-in edit distance
CELLS = 1 << 21  # numbers of neighbourhoods held at once


@dataclass(frozen=True)
class Variants:
    """A word's form has ``ratio`` times its occurrences at least; ``symbols`` fixes the size of the reduced alphabet."""

    ratio: int = 10
    symbols: int | None = None

    def __post_init__(self) -> None:
        if self.ratio < 2 or self.symbols is not None and self.symbols < 1:
            raise ValueError("a form is more frequent than its variants, and an alphabet has a symbol")


def symbols_for(words: int) -> int:
    return max(4, math.ceil(words ** (1 / 8)))


def _same_length(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and letters (a matrix of code points) of words of one length, in blocks."""
    by: dict[int, list[int]] = defaultdict(list)
    for at, t in enumerate(texts):
        by[len(t)].append(at)
    for length, places in by.items():
        step = max(1, CELLS // (16 * (length + 1)))
        for k in range(0, len(places), step):
            block = places[k:k + step]
            raw = "".join(texts[i] for i in block).encode("utf-32-le", "surrogatepass")
            yield block, np.frombuffer(raw, np.uint32).reshape(len(block), length)


def reduced(letters: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols from 1 on."""
    return (letters.astype(np.uint64) * np.uint64(BASE) >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)])


def codes(x: np.ndarray) -> np.ndarray:
    return (x * _powers(x.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def neighbourhoods(x: np.ndarray, symbols: int) -> np.ndarray:
    """Codes of each reduced word and of all its deletions, insertions and replacements, a row per word."""
    power = _powers(x.shape[1])
    terms = x * power[:-1]
    before = np.concatenate([np.zeros((len(x), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    after = whole - before
    made = [whole, before[:, :-1] + after[:, 1:] * np.uint64(INVERSE)]
    for s in np.arange(1, symbols + 1, dtype=np.uint64):
        made += [before + s * power + after * np.uint64(BASE), whole + (s - x) * power[:-1]]
    return np.concatenate(made, axis=1)


def coded(words: DataFrame, symbols: int) -> DataFrame:
    """``word, n`` and the ``code`` of the reduced word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch), np.uint64)
            for places, letters in _same_length(batch.column("word").to_pylist()):
                out[places] = codes(reduced(letters, symbols))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(out.view(np.int64))], ["word", "n", "code"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, code bigint")


def reduced_neighbours(classes: DataFrame, symbols: int) -> DataFrame:
    """``code, near``: every neighbourhood's members that are not before the reduced word itself, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters in _same_length(batch.column("word").to_pylist()):
                x = reduced(letters, symbols)
                own, near = codes(x).view(np.int64), neighbourhoods(x, symbols).view(np.int64)
                near.sort(axis=1)
                new = near >= own[:, None]
                new[:, 1:] &= near[:, 1:] != near[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, new.sum(axis=1))), pa.array(near[new])], ["code", "near"])

    return classes.select("word").mapInArrow(run, "code bigint, near bigint")


def one_edit(a: str, b: str) -> Column:
    """Whether exactly one code point inserted, deleted or replaced makes ``a`` of ``b``.

    The built-in distance takes time by the square of the length, so long words are compared behind their common
    beginning, whose length is found by halving.
    """
    la, lb = F.length(a), F.length(b)
    powers = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    common = F.aggregate(powers, F.lit(0), lambda p, k: F.when((p + k <= F.least(la, lb)) & (F.left(a, p + k) == F.left(b, p + k)), p + k).otherwise(p))
    rest = F.transform(F.array(common), lambda p: F.substring(a, p + F.when(la >= lb, 2).otherwise(1), la) == F.substring(b, p + F.when(lb >= la, 2).otherwise(1), lb))
    long = (F.col(a) != F.col(b)) & (F.abs(la - lb) <= 1) & F.get(rest, F.lit(0))
    return F.when(F.greatest(la, lb) <= LONG, F.levenshtein(a, b, 1) == 1).otherwise(long)


def near_pairs(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """``word, n, other, other_n`` for words exactly one edit apart, each unordered pair once."""
    classes = vocabulary.groupBy("code").agg(F.min("word").alias("word"))
    other = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("code").alias("near"))
    met = reduced_neighbours(classes, symbols).join(other, "near").join(vocabulary, "code")
    return (met.where((F.col("code") != F.col("near")) | (F.col("word") < F.col("other")))
            .where(one_edit("word", "other")).select("word", "n", "other", "other_n"))


def _roots(links: DataFrame) -> DataFrame:
    """``word, root``: where the forms of each word end.  Every round doubles the steps taken; forms grow at each step, so few rounds do."""
    roots = links
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        if moved.where("_moved").isEmpty():
            return roots
        after = written(moved.select("word", "root"))
        if roots is not links:
            released(roots)
        roots = after


def variant_groups(words: DataFrame, rule: Variants = Variants()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a vocabulary ``word, n`` in which each word stands once.

    A word's near words differ from it by exactly one inserted, deleted or replaced code point.  Its form is the near word
    with most occurrences, the first in code-point order of several, if it has ``ratio`` times the word's own; else null.
    The root is found by following forms to the last.  Words that are null, or whose n is null or below 1, are left out;
    the empty word is a word; an empty vocabulary gives no row; other columns are not read.
    """
    asked = written(words.select("word", F.col("n").cast("bigint").alias("n")).where("word is not null and n > 0"))
    symbols = rule.symbols or symbols_for(asked.count())
    vocabulary = written(coded(asked, symbols))
    released(asked)
    pairs = near_pairs(vocabulary, symbols)
    sides = F.array(F.struct("word", F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("b")),
                    F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("word")).alias("b")))
    near = pairs.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), F.min("b").alias("b"))
    formed = (-F.col("b.n")) >= rule.ratio * F.col("n")
    found = written(vocabulary.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("b.word")).alias("form"), F.when(formed, -F.col("b.n")).alias("form_n")))
    roots = _roots(found.where("form is not null").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
