"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns find e-mail and IP addresses, card and phone numbers.  The random field then segments the token stretches
that hold digits or an at sign.  It scores whole candidate segments (digit count, shape, checksum, borders) with a type,
and neighbouring types; dynamic programming over segments of bounded length chooses boundaries and types together.  So it
finds, for example, a card number that the greedy pattern had swallowed together with a number next to it.  Spans of the
patterns always stay, spans of the field are added where they overlap none.

The field is trained on a bounded, documented sample of stretches whose labels are the patterns' spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import written
from .common import map_texts

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [re.compile(x) for x in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
STRETCH = re.compile(r"@|[0-9](?:[\x20().-]{0,2}[0-9]){3,}")
DIGIT_OR_AT = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
OTHER = 0  # type of a token outside of personal data; kinds are 1..4


@dataclass(frozen=True)
class SpanField:
    longest: int = 16          # tokens in a segment
    around: int = 4            # tokens before and after a stretch that belong to it
    stretches: int = 600       # in the training sample, those with the smallest hash
    epochs: int = 6
    rate: float = 0.3
    ridge: float = 1e-3
    tokens: int = 400          # longer stretches are decoded in parts that overlap by a segment


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, searched for at at signs only, as its first part is slow to search."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := PATTERNS[0].match(text, start)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, by kind and start; kind counts from 0, places are code points."""
    if not text:
        return []
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in PATTERNS[1].finditer(text):
        if all(int(x) <= 255 for x in (y.lstrip("0")[:4] or "0" for y in m.group().split("."))):
            out.append((1, *m.span()))
    for m in PATTERNS[2].finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PATTERNS[3].finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def stretches(text: str, p: SpanField) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens (start, end) that can hold personal data, with some tokens around them; they do not overlap."""
    lo = hi = None
    for m in STRETCH.finditer(text):
        s, e = m.span()
        if lo is not None and s - hi > 60:
            yield _tokens(text, lo, hi, p)
            lo = None
        lo, hi = (s if lo is None else lo), e
    if lo is not None:
        yield _tokens(text, lo, hi, p)


def _tokens(text: str, lo: int, hi: int, p: SpanField) -> list[tuple[int, int]]:
    near = [m.span() for m in TOKEN.finditer(text, max(0, lo - 30), min(len(text), hi + 30))]
    first = next((i for i, t in enumerate(near) if t[1] > lo), 0)
    last = next((i for i in range(len(near) - 1, -1, -1) if near[i][0] < hi), len(near) - 1)
    while first > 0 and near[first - 1][1] == near[first][0]:
        first -= 1  # the token before touches: an address goes on to the left
    return near[max(0, first - p.around):last + 1 + p.around]


def _edge(text: str, at: int) -> int:
    """0 end of text, 1 blank, 2 digit, 3 letter, 4 other mark, 5 a mark that joins numbers."""
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 5 if c in ".-+@(" else 4


SIZES = [1, 4, 7, 9, 11, 13, 16, 17, 20]
N_FEATURES = 96


def span_features(text: str, s: int, e: int) -> list[int]:
    """Numbers of the features of the whole segment s..e."""
    x = text[s:e]
    digits = "".join(c for c in x if "0" <= c <= "9")
    n = len(digits)
    groups = x.split(".")
    out = [0, 1 + sum(n >= k for k in SIZES), 12 + min(x.count("@"), 2), 16 + min(x.count("."), 4), 22 + _edge(text, s - 1), 28 + _edge(text, e),
           34 + _edge(x, 0), 40 + _edge(x, len(x) - 1), 46 + (" " in x), 48 + ("-" in x), 50 + ("(" in x) + 2 * (")" in x), 54 + any(c.isalpha() for c in x),
           56 + (x[0] == "+"), 58 + ("\n" in x)]
    out.append(60 + (1 + luhn(digits) if 13 <= n <= 19 else 0))
    out.append(63 + (len(groups) == 4 and all(g.isascii() and g.isdigit() and len(g) <= 3 and int(g) <= 255 for g in groups)))
    out.append(65 + bool(PATTERNS[0].fullmatch(x)))
    out.append(67 + (9 <= n <= 15 and x[0] == "+"))
    out.append(69 + bool(re.fullmatch(r"[0-9 -]*", x)))
    out.append(71 + min(4, len(re.findall("[0-9]+", x))))
    out.append(76 + min(5, max(map(len, re.findall("[0-9]+", x)), default=0) // 3))
    far = text[e:e + 3].lstrip(" ().-")
    out.append(82 + (far[:1].isdigit()))
    out.append(84 + (text[max(0, s - 2):s].rstrip(" ().-")[-1:].isdigit()))
    return out


def candidates(text: str, tokens: list[tuple[int, int]], p: SpanField) -> list[tuple[int, int]]:
    """Token ranges that may be a segment of personal data: one line, a proper first and last token, digits or an at sign."""
    out = []
    for i, (s, _) in enumerate(tokens):
        first = text[s]
        if not (first.isalnum() or first in "+("):
            continue
        digits, at = 0, False
        for j in range(i, min(len(tokens), i + p.longest)):
            b, e = tokens[j]
            if j > i and (b - tokens[j - 1][1] > 1 or text[tokens[j - 1][1]:b].strip(" ")):
                break
            digits += e - b if text[b].isdigit() else 0
            at = at or text[b] == "@"
            if (digits >= 4 or at) and text[e - 1].isalnum() and (at or not any(c.isalpha() for c in text[s:e])):
                out.append((i, j + 1))
    return out


class Lattice:
    """Segments of one stretch with their features."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], p: SpanField):
        self.n, self.spans = len(tokens), candidates(text, tokens, p)
        self.features = [span_features(text, tokens[i][0], tokens[j - 1][1]) for i, j in self.spans]
        self.single = [span_features(text, s, e) for s, e in tokens]
        self.ending: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(self.spans):
            self.ending[j].append(k)

    def scores(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans = w[1:, np.array(self.features)].sum(2).T if self.spans else np.empty((0, len(KINDS)))
        return spans, w[0, np.array(self.single)].sum(1)

    def best(self, w: np.ndarray, move: np.ndarray) -> list[tuple[int, int, int]]:
        """Segments ``(first, last + 1, kind)`` of personal data in the best segmentation."""
        spans, single = self.scores(w)
        types = len(KINDS) + 1
        value, back = np.full((self.n + 1, types), -np.inf), {}
        value[0, OTHER] = 0.0
        for j in range(1, self.n + 1):
            came = value[j - 1] + move[:, OTHER]
            y = int(came.argmax())
            value[j, OTHER], back[j, OTHER] = came[y] + single[j - 1], (j - 1, y)
            for k in self.ending[j]:
                i = self.spans[k][0]
                came = value[i][:, None] + move[:, 1:]
                ys = came.argmax(0)
                got = came[ys, range(types - 1)] + spans[k]
                for t in np.flatnonzero(got > value[j, 1:]):
                    value[j, t + 1], back[j, int(t) + 1] = got[t], (i, int(ys[t]))
        out, j, y = [], self.n, int(value[self.n].argmax())
        while j:
            i, before = back[j, y]
            if y != OTHER:
                out.append((i, j, y - 1))
            j, y = i, before
        return out[::-1]

    def gradient(self, gold: list[tuple[int, int, int]], w: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood of the gold segments: what is there minus what the field expects (forward-backward)."""
        spans, single = self.scores(w)
        types = len(KINDS) + 1
        a, b = np.full((self.n + 1, types), -np.inf), np.full((self.n + 1, types), -np.inf)
        a[0, OTHER] = 0.0
        for j in range(1, self.n + 1):
            a[j, OTHER] = np.logaddexp.reduce(a[j - 1] + move[:, OTHER]) + single[j - 1]
            for k in self.ending[j]:
                came = np.logaddexp.reduce(a[self.spans[k][0]][:, None] + move[:, 1:], axis=0) + spans[k]
                a[j, 1:] = np.logaddexp(a[j, 1:], came)
        b[self.n] = 0.0
        starting: list[list[int]] = [[] for _ in range(self.n)]
        for k, (i, _) in enumerate(self.spans):
            starting[i].append(k)
        for i in range(self.n - 1, -1, -1):
            on = np.full(types, -np.inf)  # by the type of the segment that starts at i
            on[OTHER] = single[i] + b[i + 1, OTHER]
            for k in starting[i]:
                on[1:] = np.logaddexp(on[1:], spans[k] + b[self.spans[k][1], 1:])
            b[i] = np.logaddexp.reduce(move + on[None, :], axis=1)
        z = np.logaddexp.reduce(a[self.n])
        gw, gm = np.zeros_like(w), np.zeros_like(move)

        def add(i: int, j: int, kind: int, features: list[int], score: float, seen: float, before: int | None) -> None:
            flow = np.exp(a[i] + move[:, kind] + score + b[j, kind] - z)
            gw[kind, features] += seen - flow.sum()
            gm[:, kind] -= flow
            if before is not None:
                gm[before, kind] += 1.0

        marks, covered = {(i, j): k + 1 for i, j, k in gold}, np.zeros(self.n, bool)
        types_before, last = {}, OTHER
        for i, j, k in sorted(gold):
            covered[i:j] = True
        i = 0
        ends = {i: (j, k + 1) for i, j, k in gold}
        while i < self.n:
            types_before[i] = last
            i, last = ends[i] if i in ends else (i + 1, OTHER)
        for i in range(self.n):
            is_gold = not covered[i]
            add(i, i + 1, OTHER, self.single[i], single[i], float(is_gold), types_before.get(i) if is_gold else None)
        for k, (i, j) in enumerate(self.spans):
            for kind in range(1, types):
                is_gold = marks.get((i, j)) == kind
                add(i, j, kind, self.features[k], spans[k, kind - 1], float(is_gold), types_before.get(i) if is_gold else None)
        return gw, gm


def gold_segments(tokens: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pattern spans as token ranges; of spans that overlap the longer stays, spans cut by a token are left out."""
    starts, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
    out: list[tuple[int, int, int]] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1] - x[2], x)):
        if s in starts and e in ends and all(ends[e] <= i or starts[s] >= j for i, j, _ in out):
            out.append((starts[s], ends[e], kind))
    return sorted(out)


def train(sample: list[str], p: SpanField) -> tuple[np.ndarray, np.ndarray]:
    """Weights of segments by type and feature, and of moves between types, from texts labelled by the patterns."""
    w, move = np.zeros((len(KINDS) + 1, N_FEATURES)), np.zeros((len(KINDS) + 1,) * 2)
    sums = [np.full_like(w, 1e-6), np.full_like(move, 1e-6)]
    cases = []
    for text in sample:
        spans = base_spans(text)
        for tokens in stretches(text, p):
            if 0 < len(tokens) <= 80:
                gold = [g for g in gold_segments(tokens, spans) if g[1] - g[0] <= p.longest]
                lattice = Lattice(text, tokens, p)
                if all((i, j) in lattice.spans for i, j, _ in gold):
                    cases.append((lattice, gold))
    for epoch in range(p.epochs):
        for k in np.random.default_rng(epoch).permutation(len(cases)):
            lattice, gold = cases[k]
            gw, gm = lattice.gradient(gold, w, move)
            for x, g, s in ((w, gw - p.ridge * w, sums[0]), (move, gm - p.ridge * move, sums[1])):
                s += g * g
                x += p.rate * g / np.sqrt(s)
    return w, move


def _uncovered(text: str, lo: int, hi: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether a digit or an at sign between ``lo`` and ``hi`` lies in no span."""
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s > lo and DIGIT_OR_AT.search(text, lo, min(s, hi)):
            return True
        lo = max(lo, e)
    return lo < hi and DIGIT_OR_AT.search(text, lo, hi) is not None


def field_spans(text: str, base: list[tuple[int, int, int]], w: np.ndarray, move: np.ndarray, p: SpanField) -> list[tuple[int, int, int]]:
    """Spans of the field that overlap no pattern span."""
    out = []
    for tokens in stretches(text, p):
        for at in range(0, max(1, len(tokens)), p.tokens):
            part = tokens[at:at + p.tokens + p.longest]
            lo, hi = part[0][0], part[-1][1]
            inside = [b for b in base if b[1] < hi and b[2] > lo]
            # A part whose digits and at signs all lie in pattern spans has nothing to add.
            if not any(_uncovered(text, m.start(), m.end(), inside) for m in STRETCH.finditer(text, lo, hi)):
                continue
            for i, j, kind in Lattice(text, part, p).best(w, move):
                s, e = part[i][0], part[j - 1][1]
                if i < p.tokens and not any(b[1] < e and b[2] > s for b in (*base, *out)):
                    out.append((kind, s, e))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def training_sample(docs: DataFrame, p: SpanField) -> list[str]:
    """Surroundings of stretches: half from texts where the patterns find something, half from others, of smallest hash."""
    def cut(texts: list[str | None]) -> list[pa.Array]:
        found, hit = [], []
        for text in texts:
            m = STRETCH.search(text) if text else None
            s = text[max(0, m.start() - 100):m.end() + 100] if m and m.end() - m.start() < 400 else None
            found.append(s)
            hit.append(bool(s and base_spans(s)))
        return [pa.array(found, pa.string()), pa.array(hit, pa.bool_())]

    cuts = map_texts(docs.where(F.rlike("text", F.lit("@|[0-9]"))), [], {"near": "string", "hit": "boolean"}, cut).where("near is not null")
    rows = written(cuts.select("near", "hit").distinct().withColumn("h", F.xxhash64("near")))
    return [r["near"] for hit in (True, False) for r in rows.where(F.col("hit") == hit).orderBy("h", "near").limit(p.stretches // 2).collect()]


def personal_data(docs: DataFrame, p: SpanField = SpanField()) -> DataFrame:
    """Per row of ``docs (doc_id, text, ...)``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and digest are of the patterns' spans, ``spans`` lists those and the field's as ``kind:start:end``.  A null text
    is empty, an empty one has no spans.  Repeated rows are searched each; other columns are ignored; no input gives no
    rows.
    """
    w, move = train(training_sample(docs, p), p)

    def find(texts: list[str | None]) -> list[pa.Array]:
        counts, digests, all_spans = [[] for _ in KINDS], [], []
        for text in texts:
            base = base_spans(text)
            for k in range(len(KINDS)):
                counts[k].append(sum(b[0] == k for b in base))
            line = _joined(base)
            digests.append(hashlib.sha256(line.encode()).hexdigest())
            more = field_spans(text, base, w, move, p) if text else []
            all_spans.append(_joined([*base, *more]) if more else line)
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())]

    return map_texts(docs, ["doc_id"], {**{f"n_{k}": "bigint" for k in KINDS}, "base_sha256": "string", "spans": "string"}, find)
