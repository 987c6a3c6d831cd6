"""Quality rules with a character n-gram language model per language.

The model is an interpolated modified Kneser-Ney model of order 4 over 64 character classes, so it has at most 64^4 n-grams
per language whatever the corpus.  Spark counts the n-grams of all texts, derives continuation counts, discounts and
interpolation weights by grouping, and the result is held as arrays sorted by n-gram hash, which is the exact code of its
four classes.  Every text is scored against the model of its language; documents outside of the language's band of
perplexity are rejected.  The band is a number of robust deviations below and above the median of the language's documents
that pass the other rules.

Four characters do not show the order of words.  That is judged by word triples, whose number grows with the corpus: Spark
deals the triples of all texts by ranges of their hashes, finds those that other documents have too, and sums them per
document.  A document whose share of such triples is far below that of its language's other documents is rejected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.lineage import released, written
from .common import words

ORDER = 4
BITS = 6
SPACE = 0
KEY_BITS = 40  # of a word triple's hash; with 10^10 different triples one in a hundred meets another
DOC_BITS = 20  # of a document's place in its piece


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    repeat_percent: int = 50
    below: float = 5.0       # robust deviations under the median of log perplexity
    above: float = 5.0
    spread: float = 0.01     # least robust deviation, so that a language of equal documents rejects none of them
    steps: int = 1000        # histogram steps in a unit of log perplexity
    held: int = 1 << 23      # n-grams that a task holds before it sums them
    piece: int = 2 << 20     # bytes of text whose triples are sorted together
    range_bytes: int = 16 << 20  # bytes of text whose triples make one range of hashes
    below_order: float = 3.2  # robust deviations under the median of the root of the share of triples
    order_spread: float = 0.02
    model_rows: int = 8_000_000  # n-grams sent to tasks at once; more languages than fit are scored in turns


def _classes() -> np.ndarray:
    """Class of each byte: white space, letters by case, digits, five kinds of marks, four kinds of non-ASCII bytes."""
    t = np.full(256, 58, np.uint32)
    t[[9, 10, 11, 12, 13, 32]] = SPACE
    t[ord("a"):ord("z") + 1] = 1 + np.arange(26)
    t[ord("A"):ord("Z") + 1] = 27 + np.arange(26)
    t[ord("0"):ord("9") + 1] = 53
    for k, marks in enumerate([b".,;:", b"!?", b"'\"()-", b"#*$%&|<>"]):
        t[list(marks)] = 54 + k
    high = np.arange(128, 256)
    t[128:] = np.where(high >= 192, 59, 60 + high % 4)
    return t


CLASS = _classes()


def codes(raw: bytes) -> np.ndarray:
    """Codes of the 4-grams of a text; runs of white space are one blank, and a blank stands before and after it."""
    c = CLASS[np.frombuffer(raw, np.uint8)]
    c = np.concatenate([np.zeros(ORDER - 1, np.uint32), c, np.zeros(1, np.uint32)])
    blank = c == SPACE
    keep = ~blank | ~np.concatenate([[False], blank[:-1]])
    keep[:ORDER - 1] = True
    c = c[keep] if raw else c[:0]
    if len(c) < ORDER:
        return np.empty(0, np.uint32)
    n = len(c) - ORDER + 1
    out = c[:n].copy()
    for i in range(1, ORDER):
        out <<= np.uint32(BITS)
        out |= c[i:n + i]
    return out


def counted(docs: DataFrame, p: Rules) -> DataFrame:
    """``lang, code, n``: every 4-gram of every text of ``docs (lang, text)`` with its number; a null lang is ``''``."""
    def sums(lang: str, arrays: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(arrays), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int32)), pa.array(n)], ["lang", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    held.setdefault(lang or "", []).append(codes(text.encode("utf-8", "surrogatepass")))
                    size += len(held[lang or ""][-1])
                if size > p.held:
                    yield from (sums(*item) for item in held.items())
                    held, size = {}, 0
        yield from (sums(*item) for item in held.items())

    parts = docs.select("lang", "text").mapInArrow(count, "lang string, code int, n bigint")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def model(grams: DataFrame) -> DataFrame:
    """``lang, size, code, p, rest`` of every n-gram of sizes 1 to 4.

    ``p`` is its interpolated probability and ``rest`` the weight that contexts of this n-gram give to shorter ones
    (null where it is no context).  The largest n-grams are counted, shorter ones by their different left neighbours.
    """
    level, by_size = grams.select("lang", "code", "n"), {}
    for size in range(ORDER, 0, -1):
        by_size[size] = level
        if size > 1:
            level = level.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << BITS * (size - 1)) - 1)).alias("code")).agg(F.count("*").alias("n"))
    sized = None
    for size, rows in by_size.items():
        part = rows.select("lang", F.lit(size).alias("size"), "code", F.shiftright("code", BITS).alias("context"), "n")
        sized = part if sized is None else sized.union(part)
    sized = written(sized)
    ones = [F.sum((F.col("n") == k).cast("bigint")).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    # Counts of counts can be missing in tiny inputs; a discount then falls back to one that is always right, 0.5 * k.
    discount = [F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0)))).otherwise(0.5 * k).alias(f"d{k}")
                for k in (1, 2, 3)]
    cuts = sized.groupBy("lang", "size").agg(*ones).select("lang", "size", *discount)
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    less = sized.join(F.broadcast(cuts), ["lang", "size"]).withColumn("cut", d)  # four rows per language
    contexts = less.groupBy("lang", "size", "context").agg(F.sum("n").cast("double").alias("all"), F.sum("cut").alias("freed"))
    own = written(less.join(contexts, ["lang", "size", "context"]).select("lang", "size", "code", ((F.col("n") - F.col("cut")) / F.col("all")).alias("own"), (F.col("freed") / F.col("all")).alias("rest")))
    whole = own.where("size = 1").select("lang", "size", "code", (F.col("own") + F.col("rest") / (1 << BITS)).alias("p"))
    out = whole
    for size in range(2, ORDER + 1):
        shorter = whole.select("lang", F.col("code").alias("short"), F.col("p").alias("below"))
        here = own.where(F.col("size") == size).withColumn("short", F.col("code").bitwiseAND(F.lit((1 << BITS * (size - 1)) - 1)))
        whole = here.join(shorter, ["lang", "short"]).select("lang", "size", "code", (F.col("own") + F.col("rest") * F.col("below")).alias("p"))
        out = out.union(whole)
    rests = contexts.select("lang", (F.col("size") - 1).alias("size"), F.col("context").alias("code"), (F.col("freed") / F.col("all")).alias("rest"))
    return out.join(rests, ["lang", "size", "code"], "full")


class SortedModel:
    """One language's model: per size, sorted codes with log probabilities and with log interpolation weights."""

    def __init__(self, size: np.ndarray, code: np.ndarray, p: np.ndarray, rest: np.ndarray):
        self.grams, self.contexts = [], []
        for k in range(ORDER + 1):
            here = size == k
            for into, values in ((self.grams, p), (self.contexts, rest)):
                there = here & ~np.isnan(values)
                order = np.argsort(code[there], kind="stable")
                into.append((code[there][order].astype(np.uint32), np.log(np.maximum(values[there][order], 1e-12)).astype(np.float32)))

    def score(self, found: np.ndarray) -> np.ndarray:
        """Log probability of the last class of each 4-gram given the three before it."""
        out = np.zeros(len(found), np.float64)
        open_ = np.arange(len(found))
        for size in range(ORDER, 0, -1):
            mask = np.uint32((1 << BITS * size) - 1)
            code = found[open_] & mask
            keys, values = self.grams[size]
            at = np.searchsorted(keys, code)
            hit = np.zeros(len(code), bool) if not len(keys) else keys[np.minimum(at, len(keys) - 1)] == code
            out[open_[hit]] += values[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            context = (found[open_] & mask) >> np.uint32(BITS)
            keys, values = self.contexts[size - 1]
            at = np.searchsorted(keys, context)
            known = np.zeros(len(context), bool) if not len(keys) else keys[np.minimum(at, len(keys) - 1)] == context
            out[open_[known]] += values[at[known]]
        out[open_] -= BITS * np.log(2)
        return out


def arrays(rows: DataFrame) -> dict[str, SortedModel]:
    """The models of the languages in ``rows``; bounded by the languages times 64^4 n-grams."""
    t = rows.toPandas()
    return {lang: SortedModel(g["size"].to_numpy(np.int64), g["code"].to_numpy(np.int64), g["p"].to_numpy(np.float64), g["rest"].to_numpy(np.float64)) for lang, g in t.groupby("lang")}


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one text."""
    tokens = words(text)
    if not tokens:
        return 0, 0, sum(map(text.count, "#*$%&|<>")) if text else 0, 0, 0
    chars = len(text) - sum(map(text.count, "\t\n\x0b\x0c\r "))
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\r\x0b\x0c"):
            seen.add(line)
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in tokens), np.int64, len(tokens))
    repeated = 0
    if len(w) > 3:
        pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        _, inverse, n = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        again = n[inverse] > 1
        covered = np.zeros(len(w), bool)
        for i in range(3):
            covered[i:len(w) - 2 + i] |= again
        repeated = int(covered.sum())
    return len(tokens), chars, symbols, dup, repeated


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def triples(texts: list[bytes]) -> np.ndarray:
    """Sorted distinct ``hash << DOC_BITS | place`` of the word triples of texts, by a text's place in the list."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if len(starts) < 3:
        return np.empty(0, np.uint64)
    # A word is the polynomial of its bytes; one power runs through all texts and is divided out at the start of a word.
    base = np.uint64(0xD6E8FEB86659FD93)
    powers = np.full(len(raw), base, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    back = np.full(len(raw), np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    powers *= np.where(blank, 0, raw.astype(np.uint64) + np.uint64(1))
    word = _mixed(np.add.reduceat(powers, starts) * back[starts])
    doc = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]), starts, "right") - 1
    same = doc[:-2] == doc[2:]
    found = _mixed(_mixed(_mixed(word[:-2]) + word[1:-1]) + word[2:])[same] >> np.uint64(64 - KEY_BITS)
    return np.unique(found << np.uint64(DOC_BITS) | doc[2:][same].astype(np.uint64))


def packed(found: np.ndarray) -> bytes:
    """Steps between sorted hashes and the documents, byte by byte of all numbers so that the empty upper bytes vanish."""
    steps = np.diff(found >> np.uint64(DOC_BITS), prepend=np.uint64(0))
    docs = found & np.uint64((1 << DOC_BITS) - 1)
    planes = np.concatenate([x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T for x, n in ((steps, 5), (docs, 3))])
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of ``packed``."""
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).astype(np.uint64)
    steps, docs = (sum((planes[a + i] << np.uint64(8 * i) for i in range(k)), np.zeros(n, np.uint64)) for a, k in ((0, 5), (5, 3)))
    return np.cumsum(steps, dtype=np.uint64), docs


def pieces(batches: Iterator[pa.RecordBatch], p: Rules) -> Iterator[list[bytes]]:
    held, size = [], 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                held.append(text.encode("utf-8", "surrogatepass"))
                size += len(held[-1])
            if size > p.piece or len(held) >> DOC_BITS:
                yield held
                held, size = [], 0
    if held:
        yield held


def text_key(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def shared_triples(docs: DataFrame, bits: int, p: Rules) -> DataFrame:
    """``text_key, n_triples, n_shared``: different word triples of each different text, and those other rows have too.

    The triples of a piece of texts are sorted and cut into ``2^bits`` ranges of hashes.  A range is one group: what is there
    twice is shared, since a row holds a triple once.  A range returns one array per piece, the shared triples of its texts, and
    these are added up per piece.  The texts' keys travel once per piece, beside the ranges.
    """
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, texts in enumerate(pieces(batches, p)):
            piece = TaskContext.get().partitionId() << 32 | k
            found = triples(texts)
            ends = np.searchsorted(found, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(KEY_BITS + DOC_BITS - bits))
            n = np.bincount((found & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64), minlength=len(texts))
            rows = [(r, piece, len(part), packed(part)) for r, part in enumerate(np.split(found, ends)) if len(part)]
            rows.append((-1 - piece % (1 << bits), piece, len(texts), np.array([[text_key(t) for t in texts], n], np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["range", "piece", "n", "data"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["range"].iloc[0] < 0:
            return pd.DataFrame({"piece": rows["piece"], "n": rows["n"], "texts": rows["data"], "shared": None})
        parts = [unpacked(data, n) for data, n in zip(rows["data"], rows["n"])]
        hashes = np.concatenate([h for h, _ in parts])
        order = np.argsort(hashes, kind="stable")
        twice = hashes[order][1:] == hashes[order][:-1]
        shared = np.zeros(len(hashes), bool)
        shared[order[1:]] = twice
        shared[order[:-1]] |= twice
        made, at = [], 0
        for h, places in parts:
            made.append(np.bincount(places[shared[at:at + len(h)]].astype(np.int64)).astype("<u4"))
            at += len(h)
        return pd.DataFrame({"piece": rows["piece"].to_numpy(), "n": [len(n) for n in made], "texts": None, "shared": [pa.compress(n.tobytes(), codec="zstd", asbytes=True) for n in made]})

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        key, n_triples = np.frombuffer(rows["texts"].dropna().iloc[0], np.int64).reshape(2, -1)
        n_shared = np.zeros(len(key), np.int64)
        for n, data in zip(rows["n"], rows["shared"]):
            if data is not None:
                n_shared[:n] += np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4")
        return pd.DataFrame({"text_key": key, "n_triples": n_triples, "n_shared": n_shared})

    dealt = docs.select("text").mapInArrow(deal, "range int, piece bigint, n int, data binary")
    met = dealt.groupBy("range").applyInPandas(meet, "piece bigint, n int, texts binary, shared binary")
    rows = met.groupBy("piece").applyInPandas(summed, "text_key bigint, n_triples bigint, n_shared bigint")
    return rows.groupBy("text_key").agg(F.max("n_triples").alias("n_triples"), F.max("n_shared").alias("n_shared"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(docs: DataFrame, models: DataFrame, p: Rules) -> DataFrame:
    """``doc_id, lang``, the counts, ``n_grams``, ``log_sum`` (natural log of the text's probability) and ``text_key`` of every row."""
    sizes = {r["lang"]: r["count"] for r in models.groupBy("lang").count().collect()}
    turns: list[list[str]] = [[]]
    for lang, n in sorted(sizes.items()):
        if turns[-1] and sum(sizes[x] for x in turns[-1]) + n > p.model_rows:
            turns.append([])
        turns[-1].append(lang)
    lang = F.coalesce("lang", F.lit(""))
    out = None
    for k, group in enumerate(turns):
        # The first turn also takes what no model knows.
        part = docs.where(lang.isin(group)) if k else docs.where(~lang.isin([x for g in turns[1:] for x in g])) if turns[1:] else docs
        sent = docs.sparkSession.sparkContext.broadcast(arrays(models.where(F.col("lang").isin(group))))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, rows = batch.column("text").to_pylist(), []
                for lang, text in zip(batch.column("lang").to_pylist(), texts):
                    known = sent.value.get(lang or "")
                    found = codes(text.encode("utf-8", "surrogatepass")) if text and known else np.empty(0, np.uint32)
                    key = text_key(text.encode("utf-8", "surrogatepass")) if text else None
                    rows.append((*counts_of(text), len(found), float(known.score(found).sum()) if len(found) else 0.0, key))
                made = [pa.array([r[i] for r in rows], pa.float64() if i == 6 else pa.int64()) for i in range(8)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *made], ["doc_id", "lang", *COUNTS, "n_grams", "log_sum", "text_key"])

        made = part.select("doc_id", "lang", "text").mapInArrow(score, "doc_id bigint, lang string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", n_grams bigint, log_sum double, text_key bigint")
        out = made if out is None else out.union(made)
    return out


def _median(hist: DataFrame, value: str, share: float = 0.5) -> DataFrame:
    """Median, or value at another share, of ``value`` by ``lang_key`` from a histogram with counts ``n``; a few thousand rows per language."""
    w = W.partitionBy("lang_key")
    upto = w.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = hist.groupBy("lang_key", value).agg(F.sum("n").alias("n")).withColumn("c", F.sum("n").over(upto)).withColumn("t", F.sum("n").over(w))
    return steps.where(F.col("c") >= share * F.col("t")).groupBy("lang_key").agg(F.min(value).alias(value))


def bands(scores: DataFrame, p: Rules) -> DataFrame:
    """``lang_key, low, high``: bounds of log perplexity per language from its documents that pass the other rules."""
    hist = written(scores.where("not base_failed and log_ppl is not null").groupBy("lang_key", F.round(F.col("log_ppl") * p.steps).cast("bigint").alias("step")).agg(F.count("*").alias("n")))
    middle = _median(hist, "step").withColumnRenamed("step", "mid")
    away = hist.join(middle, "lang_key").select("lang_key", "n", F.abs(F.col("step") - F.col("mid")).alias("away"))
    spread = F.greatest(F.col("away") * F.lit(1.4826) / p.steps, F.lit(p.spread))
    found = middle.join(_median(away, "away"), "lang_key")
    return found.select("lang_key", (F.col("mid") / p.steps - p.below * spread).alias("low"), (F.col("mid") / p.steps + p.above * spread).alias("high"))


def order_bounds(scores: DataFrame, p: Rules) -> DataFrame:
    """``lang_key, least``: least root of the share of triples, from documents that are no copies (less than nine tenths are shared)."""
    hist = written(scores.where("rooted is not null and 10 * n_shared < 9 * n_triples").groupBy("lang_key", F.round(F.col("rooted") * p.steps).cast("bigint").alias("step")).agg(F.count("*").alias("n")))
    found = _median(hist, "step").join(_median(hist, "step", 0.25).withColumnRenamed("step", "low"), "lang_key")
    spread = F.greatest((F.col("step") - F.col("low")) * F.lit(1.4826) / p.steps, F.lit(p.order_spread))
    return found.select("lang_key", (F.col("step") / p.steps - p.below_order * spread).alias("least"))


def base_failed(p: Rules) -> Column:
    return (F.col("n_words") < p.least_words) | (100 * F.col("n_repeat_words") > p.repeat_percent * F.col("n_words"))


def quality_rules(docs: DataFrame, p: Rules = Rules()) -> DataFrame:
    """Per row of ``docs (doc_id, text, lang, ...)``: doc_id, lang, the counts, ``base_failed``, ``perplexity``, ``kept``, and the
    numbers of different word triples and of those that other rows have too.

    A null text has no words.  A missing lang is a language of its own.  Texts without n-grams have no perplexity and fail
    the base rules.  A language without any document that passes the base rules has no band and keeps none.  Rows of one
    doc_id are judged each by their own text; other columns are ignored; no input gives no rows.
    """
    grams = written(counted(docs, p))
    models = written(model(grams))
    log_ppl = F.when(F.col("n_grams") > 0, -F.col("log_sum") / F.col("n_grams"))
    scores = written(scored(docs, models, p).withColumn("lang_key", F.coalesce("lang", F.lit(""))).withColumn("base_failed", base_failed(p)).withColumn("log_ppl", log_ppl))
    size = grams.agg(F.sum("n")).head()[0] or 0
    released(grams, models)
    limits = bands(scores, p)
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    judged = scores.join(limits, "lang_key", "left").withColumn("passed", ~F.col("base_failed") & inside)
    # The root has the same sampling error at every share, so that short texts with few triples are not judged by chance.
    root = F.sqrt((F.col("n_shared") + 0.375) / (F.col("n_triples") + 0.75))
    order = written(shared_triples(docs, max(3, int(size // p.range_bytes).bit_length()), p))
    ordered = written(judged.join(order, "text_key", "left").withColumn("rooted", F.when(F.col("passed") & (F.col("n_triples") > 0), root)))
    released(order, scores)
    kept = F.col("passed") & F.coalesce(F.col("rooted") >= F.col("least"), F.lit(True))
    more = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_triples", "n_shared")]
    return ordered.join(order_bounds(ordered, p), "lang_key", "left").select("doc_id", "lang", *COUNTS, "base_failed", F.exp("log_ppl").alias("perplexity"), kept.alias("kept"), *more)
