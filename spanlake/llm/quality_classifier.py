"""Text quality from positive and unlabelled documents.

Documents labelled good are trusted positives, all documents are unlabelled web text, and the share of good ones in it,
the class prior, is estimated from the labelled rows that may be used.  A logistic model over style measures minimises the
non-negative unbiased risk

    prior * E_pos[loss(f)] + max(0, E_all[loss(-f)] - prior * E_pos[loss(-f)])

With the logistic loss the first form is convex, so Newton steps are taken on sums that Spark gathers over all documents;
where the second term would go below zero, a step is taken back along its gradient instead.  Documents labelled bad serve
for the prior only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import written
from .common import as_row, map_texts, rows_of


@dataclass(frozen=True)
class PULearning:
    steps: int = 25
    ridge: float = 1e-4
    shrink: float = 5.0       # the ridge is at least this over the number of positives, as few rows fit anything
    close: float = 1e-4       # largest change of a weight at which steps end
    back: float = 0.5         # size of a step back
    threshold: float = 0.3
    folds: int = 5            # the rows of fold 0 are held out
    least_prior: float = 0.05
    most_prior: float = 0.99


MARKS, END = b"#*$%&|<>", b"#*$%&|<>!"
RATIOS = 14


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 other, 1 lower case, 2 upper case, 3 digit, 4 mark, 5 exclamation, 6 stop or comma, 7 non-ASCII, 8 white space."""
    t = np.zeros(256, np.uint8)
    for kind, members in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, MARKS), (5, b"!"), (6, b".,"), (7, range(128, 256)), (8, b"\t\n\x0b\x0c\r ")):
        t[list(members)] = kind
    return t


KINDS = _kinds()


def measures(text: str | None) -> np.ndarray:
    """Shares and lengths that describe the style of one text; zeros without words."""
    out = np.zeros(RATIOS + 3)
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    tokens = raw.split()
    if not tokens:
        return out
    n = len(tokens)
    by = np.bincount(KINDS[np.frombuffer(raw, np.uint8)], minlength=9)
    ink = max(1, len(raw) - by[8])
    out[:7] = by[1:8] / ink
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in tokens), np.int64, n)
    out[7] = (w[1:] == w[:-1]).sum() / n
    out[8] = np.bincount(w).max() / n
    out[9] = len(ids) / n ** 0.9 if n > 1 else 1
    out[10] = sum(len(x) == 1 and x in MARKS for x in tokens) / n
    out[11] = sum(x[-1] in END for x in tokens) / n
    out[12] = sum(x.isupper() and len(x) > 1 for x in tokens) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[13] = 1 - len(set(lines)) / len(lines)
    out[14] = ink / n / 10
    out[15] = np.log1p(n) / 10
    out[16] = np.log1p(n / len(lines)) / 10
    return out


def features(text: str | None) -> np.ndarray:
    """Measures, with roots and soft steps of the shares, and a constant."""
    m = measures(text)
    r = m[:RATIOS]
    return np.concatenate([m, np.sqrt(np.abs(r)), r / (r + 0.02), [1.0]]).astype(np.float64)


WIDTH = RATIOS * 3 + 4


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: features of every row as 4-byte floats in binary form."""
    def describe(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([features(t).astype(np.float32).tobytes() for t in texts], pa.binary())]
    return map_texts(docs, ["doc_id"], {"x": "binary"}, describe)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_labels(labels: DataFrame, p: PULearning) -> DataFrame:
    """``doc_id, quality`` outside of the held-out fold; a document with different labels counts as bad."""
    fine = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), p.folds) != 0))
    return fine.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64)


def _sums(rows: DataFrame, part) -> np.ndarray:
    """Sum over all rows of the vectors that ``part(x, positive)`` gives for an Arrow batch; added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = part(_matrix(batch), batch.column("positive").to_numpy(zero_copy_only=False).astype(bool))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    summed = rows.select("x", "positive").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(summed, key=lambda r: r["i"])])


def fit(rows: DataFrame, prior: float, p: PULearning) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Weights, means and scales from ``x, positive`` of all documents; None without positives."""
    d = WIDTH
    first = _sums(rows, lambda x, pos: np.concatenate([[len(x), pos.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(first) or not first[1]:
        return None
    n, n_pos = first[:2]
    mean = first[2:2 + d] / n
    scale = np.sqrt(np.maximum(first[2 + d:] / n - mean ** 2, 0))
    mean[-1], scale = 0.0, np.where(scale > 1e-9, scale, 1.0)

    pos_mean = _sums(rows, lambda x, pos: np.clip((x[pos] - mean) / scale, -30, 30).sum(0)) / n_pos
    w = np.zeros(d)
    w[-1] = np.log(prior / (1 - prior))
    penalty = np.full(d, max(p.ridge, p.shrink / n_pos))
    penalty[-1] = 1e-9
    for _ in range(p.steps):
        def part(x: np.ndarray, pos: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = np.clip((x - mean) / scale, -30, 30)
            f = np.clip(z @ w, -60, 60)
            s = 1 / (1 + np.exp(-f))
            loss = np.logaddexp(0, f)  # of calling the document bad
            grad_pos = (z[pos] * s[pos, None]).sum(0)
            return np.concatenate([[loss.sum(), loss[pos].sum()], z.T @ s, grad_pos, (z.T @ (z * (s * (1 - s))[:, None])).ravel()])

        v = _sums(rows, part)
        negative = v[0] / n - prior * v[1] / n_pos
        all_grad, pos_grad, hessian = v[2:2 + d] / n, v[2 + d:2 + 2 * d] / n_pos, v[2 + 2 * d:].reshape(d, d) / n
        if negative < 0:
            step = -p.back * (all_grad - prior * pos_grad)
        else:
            step = np.linalg.solve(hessian + np.diag(penalty + 1e-6), all_grad - prior * pos_mean + penalty * w)
            step /= max(1.0, np.abs(step).max() / 2)  # far from the optimum the curvature is too small to be trusted
        w = w - step
        if np.abs(step).max() < p.close:
            break
    return w, mean, scale


def quality_scores(docs: DataFrame, labels: DataFrame, p: PULearning = PULearning()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs (doc_id, text, ...)``, with ``labels (doc_id, quality, ...)``.

    ``score`` lies in 0..1; null and empty texts are scored as texts without words.  Labels other than 0 and 1, without an
    id or of the held-out fold teach nothing; labels of documents that are not there are left out.  Without any positive
    the score is the prior for all (0.5 without labels).  A row without an id is not held out.  Rows that repeat an id
    are scored each by its own text; other columns are ignored; no input gives no rows.
    """
    known = training_labels(labels, p)
    marked = described(docs).join(known, "doc_id", "left").select("doc_id", "x", "quality", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("positive"))
    rows = written(marked)
    seen = rows.agg(F.count("quality"), F.sum("quality")).first()
    share = seen[1] / seen[0] if seen[0] else 0.5
    prior = min(max(share, p.least_prior), p.most_prior) if seen[0] else 0.5
    found = fit(rows, prior, p)
    out = rows.select("doc_id", "x")
    if found is None:
        scored = out.select("doc_id", F.lit(prior).alias("score"))
    else:
        w, mean, scale = found

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f = np.clip(np.clip((_matrix(batch) - mean) / scale, -30, 30) @ w, -60, 60) if batch.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-f)))], ["doc_id", "score"])

        scored = out.mapInArrow(score, "doc_id bigint, score double")
    held = F.coalesce(fold(F.col("doc_id"), p.folds) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, p: PULearning = PULearning()) -> DataFrame:
    """Rows of ``docs`` whose document is predicted good, columns unchanged; rows without an id are judged together.

    Of rows that repeat an id all stay if one of them is good.
    """
    good = quality_scores(docs, labels, p).where("predicted = 1").select(F.col("doc_id").alias("_good")).distinct()
    return rows_of(as_row(docs, "doc_id").join(good, F.col("doc_id").eqNullSafe(F.col("_good")), "left_semi"))
