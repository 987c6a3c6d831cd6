"""Periodic stretches of words, found with a dictionary of basic factors.

A basic factor is a stretch whose length is a power of two; the dictionary names it, equal factors alike, and a factor of
twice the length is named by the pair of its halves.  Per length, each place looks at the next place with the same name.
Places at most twice the length apart, three of them at equal steps, form an arithmetic progression, and its step is
proposed as a period.  Inside a run of period q, factors of q words or more return after exactly q words and never earlier,
so with four periods in the run the shortest such power of two proposes q.  A proposal is extended word by word to both
sides, and what several lengths propose is kept once.

Nothing is longer than the text: names of one length are held at a time, so memory is a few numbers a word, and time is
that of sorting the words once per power of two that still has repeated factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, words

RUN = "struct<start:bigint,length:bigint,period:bigint>"
ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
BLOCK = 64  # words compared at once where an extension begins


@dataclass(frozen=True)
class Repeats:
    """A run has ``least`` words or more and ``periods`` times its period or more."""

    least: int = 6
    periods: int = 4

    def __post_init__(self) -> None:
        if self.periods < 4:
            raise ValueError("three equal steps of a factor are certain from four periods on")


def _agreement(w: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch of places around ``at`` whose word equals the one ``period`` later: (first, one after the last)."""
    last, step = len(w) - period, BLOCK
    first = end = at
    while end < last:
        stop = min(end + step, last)
        other = np.flatnonzero(w[end:stop] != w[end + period:stop + period])
        if len(other):
            end += int(other[0])
            break
        end, step = stop, step * 2
    step = BLOCK
    while first > 0:
        stop = max(first - step, 0)
        other = np.flatnonzero(w[stop:first] != w[stop + period:first + period])
        if len(other):
            first = stop + int(other[-1]) + 1
            break
        first, step = stop, step * 2
    return first, end


def _proposals(order: np.ndarray, same: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of progressions of three places; ``order`` has places by name, ``same`` says where a name goes on.

    Neighbouring places with one period lie in one run, so the first of them stands for all.
    """
    gap = np.zeros(len(order), np.int64)
    near = same & (np.diff(order) <= reach)
    gap[order[:-1][near]] = np.diff(order)[near]
    at = np.flatnonzero(gap)
    at = at[gap[at + gap[at]] == gap[at]]
    by = np.lexsort((at, gap[at]))
    at, period = at[by], gap[at][by]
    first = np.ones(len(at), bool)
    first[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    return at[first], period[first]


def runs_of(w: np.ndarray, rule: Repeats = Repeats()) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of a sequence of whole numbers, by start and period."""
    found: set[tuple[int, int, int]] = set()
    names, size = w.astype(np.int64), 1
    while len(names) > 1 and rule.periods * (size // 2 + 1) <= len(w):  # shorter periods have been proposed by shorter factors
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        if not same.any():
            break
        for at, period in zip(*map(np.ndarray.tolist, _proposals(order, same, 2 * size))):
            first, end = _agreement(w, at, period)
            if (length := end - first + period) >= max(rule.least, rule.periods * period):
                found.add((first, length, period))
        name = np.empty(len(order), np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        names = name[:-size] * (int(name.max()) + 1) + name[size:]
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_runs(text: str | None, rule: Repeats = Repeats()) -> tuple[int, list[tuple[int, int, int]], str]:
    """(number of words, runs, collapsed text): words that a run holds after its first period are left out."""
    ws = words(text)
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in ws), np.int64, len(ws))
    runs = runs_of(w, rule) if len(ids) < len(ws) else []
    if runs:
        kept = np.ones(len(ws), bool)
        for start, length, period in runs:
            kept[start + period:start + length] = False
        ws = [x for x, k in zip(ws, kept.tolist()) if k]
    return len(w), runs, b" ".join(ws).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, rule: Repeats = Repeats(), passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``passed`` columns, ``n_words``, ``runs`` (start, length, period) and the text ``collapsed``.

    A run is a stretch with a smallest period that no neighbouring word extends; runs may overlap and are sorted by start
    and period.  ``collapsed`` has the words outside of runs and the first period of each run, unless another run drops
    them, with one blank between words.  Null and empty texts have no words, no runs and an empty collapsed text.  Repeated
    rows are each their own document, an empty table gives an empty one, and columns that are not passed are not read.
    """
    def found(texts: list[str | None]) -> list[pa.Array]:
        n, runs, collapsed = zip(*(word_runs(t, rule) for t in texts)) if texts else ((), (), ())
        named = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
        return [pa.array(n, pa.int64()), pa.array(named, pa.list_(ARROW_RUN)), pa.array(collapsed, pa.string())]

    return map_texts(docs, list(passed), {"n_words": "bigint", "runs": f"array<{RUN}>", "collapsed": "string"}, found)
