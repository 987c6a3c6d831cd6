"""Removal of passages of several lines that occur elsewhere, found as content-defined chunks of lines.

A text is cut after line i where the rolling hash over its last lines is a strict local minimum.  The cut depends on
nothing but the lines around it, so inserting or deleting lines elsewhere does not move it, and no two cuts are adjacent.
Only built-in functions are used: texts are split, hashed and put together again by array expressions, grouping by the
chunk's bytes finds what is repeated, and the first document that has a chunk keeps it.

The lines at the edge of a repeated passage share a chunk with lines of their own, which no boundary rule can avoid.  A
line of more than ``LONG`` words is a passage by itself, so it is compared as a unit too, whatever chunk it lies in.  Long
lines are most of the text, so the first half of their SHA-256 stands for them in the shuffle; it holds no line break, as every chunk does.

Chunks alone miss most passages of few lines.  ``passage_dedup`` therefore compares, for every line that is not blank, the
shortest run of lines from there on with more than ``LONG`` words, named in the same way; a long line is such a run by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import written
from .common import WORD, as_row, columns_of, evaluated, salted_join

BASE, MODULUS, HIGHEST = 1_000_003, (1 << 40) - 87, (1 << 63) - 1
LONG = 50  # words beyond which a line is compared by itself


def _rolled(window: int) -> Column:
    """Hash of a polynomial over the 31-bit hashes of the last ``window`` lines, kept small enough not to overflow."""
    def at(i: Column) -> Column:
        value = F.lit(0).cast("bigint")
        for back in range(window):
            value = (value * F.lit(BASE) + F.get("h", i - F.lit(back))) % F.lit(MODULUS)
        return F.xxhash64(value)
    return F.transform("h", lambda _, i: F.when(i >= F.lit(window - 1), at(i)))


def chunks(docs: DataFrame, passed: list[str], window: int = 2) -> DataFrame:
    """The ``passed`` columns and ``chunks``, the text of each chunk in order; joined by line breaks they give the text.

    A null text has no chunk, an empty one has one empty chunk.
    """
    lines = evaluated(docs, *passed, F.split("text", "\n", -1).alias("l"))
    hashed = evaluated(lines, *passed, F.col("l"), F.transform("l", lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << 31) - 1))).alias("h"))
    rolled = evaluated(hashed, *passed, F.col("l"), _rolled(window).alias("r"))
    last = F.size("l") - F.lit(1)

    def minimum(i: Column) -> Column:
        here, before, after = F.get("r", i), F.get("r", i - F.lit(1)), F.get("r", i + F.lit(1))
        return (i == last) | F.coalesce((here < F.coalesce(before, F.lit(HIGHEST))) & (here < F.coalesce(after, F.lit(HIGHEST))), F.lit(False))

    ends = evaluated(rolled, *passed, F.col("l"), F.filter(F.sequence(F.lit(0), last), minimum).alias("e"))

    def chunk(end: Column, j: Column) -> Column:
        start = F.coalesce(F.get("e", j - F.lit(1)) + F.lit(1), F.lit(0))
        return F.array_join(F.slice("l", start + F.lit(1), end - start + F.lit(1)), "\n")

    return evaluated(ends, *passed, F.coalesce(F.transform("e", chunk), F.array().cast("array<string>")).alias("chunks"))


def _several_lines(chunk: Column) -> Column:
    return F.contains(chunk, F.lit("\n")) & F.rlike(chunk, F.lit(WORD))


def _lines(chunks: Column) -> Column:
    return F.flatten(F.transform(chunks, lambda c: F.split(c, "\n", -1)))


def _long(line: Column) -> Column:
    """More than ``LONG`` words; so many have twice as many bytes at least, which is tested first."""
    return F.when(F.octet_length(line) > 2 * LONG, F.regexp_count(line, F.lit(WORD)) > LONG).otherwise(F.lit(False))


def _covered(chunk: Column) -> Column:
    """Runs cover every line of the chunk: it begins with words and its last line is long, so runs from all its lines end in it."""
    return _long(F.substring_index(chunk, "\n", -1)) & F.rlike(F.substring_index(chunk, "\n", 1), F.lit(WORD))


def _digest(text: Column) -> Column:
    return F.base64(F.unhex(F.left(F.sha2(text, 256), F.lit(32))))


def _name(line: Column) -> Column:
    return F.when(_long(line), _digest(line))


def _runs(df: DataFrame, lines: Column, passed: list[str]) -> DataFrame:
    """The ``passed`` columns and ``runs``: first and last line and name of the shortest run of more than ``LONG`` words from each line.

    Lines without words are not counted and not named, so a run has at most ``LONG + 1`` lines.
    """
    counted = F.transform(lines, lambda x, k: F.struct(x.alias("x"), k.alias("k"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    worded = evaluated(df, *passed, F.filter(counted, lambda s: s["w"] > 0).alias("_p"))
    parts = evaluated(worded, *passed, F.col("_p.x").alias("_x"), F.col("_p.k").alias("_k"), F.col("_p.w").alias("_w"))

    def size(w: Column, i: Column) -> Column:
        def more(a: Column, b: Column) -> Column:
            return F.when(a["t"] > LONG, a).otherwise(F.struct((a["t"] + b).alias("t"), (a["n"] + F.lit(1)).alias("n")))
        walked = F.aggregate(F.slice("_w", i + F.lit(1), F.lit(LONG + 1)), F.struct(F.lit(0).alias("t"), F.lit(0).alias("n")), more, lambda a: F.when(a["t"] > LONG, a["n"]))
        return F.when(w > LONG, F.lit(1)).otherwise(walked)

    sized = evaluated(parts, *passed, F.col("_x"), F.col("_k"), F.transform("_w", size).alias("_n"))

    def run(x: Column, i: Column) -> Column:
        n = F.get("_n", i)
        text = F.when(n == 1, x).when(n > 1, F.array_join(F.slice("_x", i + F.lit(1), n), "\n"))
        return F.struct(F.get("_k", i).alias("s"), F.get("_k", i + n - F.lit(1)).alias("e"), _digest(text).alias("name"))

    return evaluated(sized, *passed, F.filter(F.transform("_x", run), lambda r: r["name"].isNotNull()).alias("runs"))


def units(docs: DataFrame, window: int = 2, runs: bool = False) -> DataFrame:
    """``doc_id, chunk`` of what is compared: chunks of several lines, not all blank, and names of long lines or of runs."""
    cut = chunks(docs.select("doc_id", "text"), ["doc_id"], window)
    if runs:
        found = _runs(evaluated(cut, F.col("doc_id"), F.filter("chunks", lambda c: _several_lines(c) & ~_covered(c)).alias("chunks"), _lines(F.col("chunks")).alias("_l")), F.col("_l"), ["doc_id", "chunks"])
        return found.select("doc_id", F.explode(F.concat("chunks", F.col("runs.name"))).alias("chunk"))
    compared = F.concat(F.filter("chunks", _several_lines), F.array_compact(F.transform(_lines(F.col("chunks")), _name)))
    return cut.select("doc_id", F.explode(compared).alias("chunk"))


def repeated_chunks(docs: DataFrame, window: int = 2, runs: bool = False) -> DataFrame:
    """``chunk, n, first_doc`` of every unit that occurs more than once in ``docs``."""
    return units(docs, window, runs).groupBy("chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def _marked(docs: DataFrame, names: list[str], window: int, runs: bool) -> DataFrame:
    """Every row of ``docs`` as ``_row`` with ``chunks``, and as ``_bytes`` and ``_first`` its repeated units and their first documents."""
    found = repeated_chunks(docs, window, runs)
    narrow = written(units(docs.where(F.col("doc_id").isNotNull()), window, runs).select("doc_id", F.xxhash64("chunk").alias("h")).distinct())
    hits = salted_join(narrow, found.select(F.xxhash64("chunk").alias("h"), "chunk", "first_doc"), "h", "doc_id")
    marks = hits.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("chunk", "first_doc")).alias("_same"))
    row = as_row(columns_of(docs, names), "doc_id").join(marks, F.col("doc_id") == F.col("_doc"), "left")
    # One pass over all rows, as a second one would shuffle the texts again; only texts with marks are cut.
    marked = row.select("_row", F.when(F.col("_same").isNotNull(), F.col("_row.text")).alias("text"), "_same")
    return evaluated(chunks(marked, ["_row", "_same"], window), F.col("_row"), F.col("chunks"), F.transform("_same", lambda s: s["chunk"]).alias("_bytes"),
                     F.transform("_same", lambda s: s["first_doc"]).alias("_first"))


def _first_of(name: Column) -> tuple[Column, Column]:
    """Whether a unit is a repeated one, and the first document that has it."""
    at = F.coalesce(F.array_position("_bytes", name), F.lit(0))  # compares the bytes
    return at > 0, F.get("_first", (at - F.lit(1)).cast("int"))


def line_dedup(docs: DataFrame, window: int = 2) -> DataFrame:
    """Every row of ``docs`` with ``text`` freed of repeated chunks and long lines, and ``n_removed``, the number of them removed.

    The copy in the smallest doc_id stays, and in that document the first one.  Rows of one doc_id count as one document,
    each of them keeps its first copy if the document is the first; a row without a doc_id keeps its whole text.  Null texts stay null, empty ones empty; what is left over keeps its bytes.  Extra columns stay;
    ``n_removed`` replaces a column of that name.
    """
    names = [c for c in docs.columns if c != "n_removed"]
    cut = _marked(docs, names, window, runs=False)

    def kept(among: str, named=lambda c: c):
        def unit(c: Column, j: Column) -> Column:
            again, first = _first_of(named(c))
            return ~again | ((first == F.col("_row.doc_id")) & (F.array_position(among, c) == j + 1))
        return unit

    # A unit's first copy in its first document outlives the removal of chunks, as a chunk around it would have come first there too.
    left = evaluated(cut, F.col("_row"), F.col("_bytes"), F.col("_first"), F.size("chunks").alias("_n"), F.when(F.col("_bytes").isNotNull(), F.filter("chunks", kept("chunks"))).alias("_left"))
    lines = evaluated(left, F.col("_row"), F.col("_bytes"), F.col("_first"), (F.col("_n") - F.size("_left")).alias("_n"), _lines(F.col("_left")).alias("_lines"))
    rest = evaluated(lines, F.col("_row"), (F.col("_n") + F.size("_lines")).alias("_n"), F.filter("_lines", kept("_lines", _name)).alias("_rest"))
    text = F.when(F.col("_rest").isNull(), F.col("_row.text")).otherwise(F.array_join("_rest", "\n")).alias("text")
    return rest.select(*[text if c == "text" else F.col("_row")[c].alias(c) for c in names], F.coalesce(F.col("_n") - F.size("_rest"), F.lit(0)).alias("n_removed"))


def passage_dedup(docs: DataFrame, window: int = 2) -> DataFrame:
    """As ``line_dedup``, and without the lines of every run of more than ``LONG`` words that another document has before.

    The first document keeps its first copy of a run and loses later ones that do not overlap it.  Blank lines inside of a
    removed run go with it.  ``n_removed`` counts the removed lines.
    """
    names = [c for c in docs.columns if c != "n_removed"]
    cut = _marked(docs, names, window, runs=True)
    own = F.col("_row.doc_id")

    def judged(c: Column, j: Column) -> Column:
        again, first = _first_of(c)
        return F.coalesce(~again | ((first == own) & (F.array_position("chunks", c) == j + 1)), F.lit(False))

    stays = evaluated(cut, F.col("_row"), F.col("chunks"), F.col("_bytes"), F.col("_first"), F.when(F.col("_bytes").isNotNull(), F.transform("chunks", judged)).alias("_stays"))
    flags = F.flatten(F.transform("chunks", lambda c, j: F.transform(F.split(c, "\n", -1), lambda _: F.get("_stays", j))))
    split = evaluated(stays, F.col("_row"), F.col("_bytes"), F.col("_first"), F.when(F.col("_stays").isNotNull(), flags).alias("_flags"),
                      F.when(F.col("_stays").isNotNull(), _lines(F.col("chunks"))).alias("_lines"))
    passed = ["_row", "_bytes", "_first", "_flags", "_lines"]
    run = evaluated(_runs(split, F.col("_lines"), passed), *passed, F.col("runs"), F.col("runs.name").alias("_names"))

    def removed(r: Column) -> Column:
        again, first = _first_of(r["name"])
        before = F.get("runs", (F.array_position("_names", r["name"]) - F.lit(1)).cast("int"))
        return again & (~first.eqNullSafe(own) | (before["e"] < r["s"]))

    ranges = evaluated(run, *[F.col(c) for c in passed], F.filter("runs", removed).alias("_ranges"))
    open_ = evaluated(ranges, *[F.col(c) for c in passed], F.transform("_lines", lambda _, k: ~F.exists("_ranges", lambda r: (r["s"] <= k) & (k <= r["e"]))).alias("_open"))
    left = evaluated(open_, F.col("_row"), F.size("_lines").alias("_n"), F.filter("_lines", lambda _, k: F.get("_flags", k) & F.get("_open", k)).alias("_rest"))
    text = F.when(F.col("_rest").isNull(), F.col("_row.text")).otherwise(F.array_join("_rest", "\n")).alias("text")
    count = F.when(F.col("_rest").isNotNull(), F.col("_n") - F.size("_rest"))
    return left.select(*[text if c == "text" else F.col("_row")[c].alias(c) for c in names], F.coalesce(count, F.lit(0)).alias("n_removed"))
