"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One score s(text) and ordered thresholds t_1 <= ... <= t_(K-1) give P(grade > k) = sigmoid(s - t_k).  The score is a sum of
shared weights over hashed text features: the mean over all 3-byte grams of the text, and one weight for each of a few binned shape
features (share of distinct words, mean word length, shares of capitals and of signs).  Grades may be any integers; they are ranked.
`expected_grade` and `tail_probability` (of a grade of at least the tail grade) select documents.

The model is trained in numpy on the driver on a bounded sample: about `per_grade` rated documents of each grade, drawn by a hash
of the id; whole texts, turned into feature counts on the executors.  Scoring is one pass without a shuffle.

Null and empty texts: no grams, shape features of an empty text.  A document rated several times counts with its highest grade; null ratings don't
count, nor do ratings of documents that aren't there.  With fewer than two grades every document gets that grade (0 if there is none) and tail probability 1.  Repeated rows are
scored alike; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import chunks, shared, small_batches, tidy, utf8, word_hashes

GRAM_BITS = 15
SHAPES = ("distinct", "length", "capitals", "signs")
BINS = 12
SIZE = (1 << GRAM_BITS) + len(SHAPES) * BINS
_KIND = np.zeros(256, dtype=np.int8)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 2


def gram_codes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed 3-byte grams of all texts (two spaces end each), and each text's first (the end at last)."""
    buf = np.frombuffer(b"  ".join(texts) + b"  ", dtype=np.uint8).astype(np.uint32)
    c = buf[:-2] * np.uint32(0x9E3779B1) ^ buf[1:-1] * np.uint32(0x85EBCA77) ^ buf[2:] * np.uint32(0xC2B2AE3D)
    c ^= c >> np.uint32(15)
    c *= np.uint32(0x2C1B3C6D)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    own = np.arange(at[-1]) + np.repeat(2 * np.arange(len(texts)), np.diff(at))
    return (c[own] >> np.uint32(32 - GRAM_BITS)).astype(np.int32), at


def _bin(share: np.ndarray) -> np.ndarray:
    return np.clip((share * BINS).astype(np.int64), 0, BINS - 1)


def shapes(texts: Sequence[bytes]) -> np.ndarray:
    """(text, shape) feature numbers."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)])
    kind = _KIND[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    size = np.array([len(t) for t in texts])
    count = lambda k: np.diff(np.concatenate([[0], np.cumsum(kind == k)[ends - 1]]))
    some = np.maximum(size, 1)
    bins = [_bin(distinct / np.maximum(n, 1)), np.minimum(size // np.maximum(n, 1) // 2, BINS - 1), _bin(count(1) / some), _bin(count(2) / some)]
    return np.stack([(1 << GRAM_BITS) + i * BINS + b for i, b in enumerate(bins)], axis=1)


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in chunks(texts):
            code, at = gram_codes(texts[a:b])
            total = np.concatenate([[0.0], np.cumsum(self.weights[code[: at[-1]]], dtype=np.float64)])
            means = np.diff(total[at]) / np.maximum(np.diff(at), 1)
            out[a:b] = means + self.weights[shapes(texts[a:b])].sum(axis=1)
        return out

    def above(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, (text, threshold)."""
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, grades: list[int], steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> OrdinalModel:
    """Adam on the mean negative log-likelihood; classes weigh alike.  Gaps between thresholds are squares, so they stay ordered."""
    n, k = len(y), len(grades)
    w, free = np.zeros(SIZE), np.concatenate([[0.0], np.full(max(0, k - 2), 1.0)])
    if k < 2:
        return OrdinalModel(grades or [0], w, np.zeros(0))
    share = 1 / (k * np.maximum(1, np.bincount(y, minlength=k)))[y]
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(free), np.zeros_like(free)]
    edges = lambda t: (np.concatenate([[-np.inf], t])[y], np.concatenate([t, [np.inf]])[y])
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        t = free[0] + np.concatenate([[0.0], np.cumsum(free[1:] ** 2)])
        s = np.bincount(rows, w[cols] * values, n)
        low, high = edges(t)
        a, b = sig(high - s), sig(low - s)
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a), b * (1 - b)
        gs = share * (da - db) / p
        gt = np.zeros(k - 1)
        for j in range(k - 1):
            gt[j] = -(share * np.where(y == j, da, 0) / p).sum() + (share * np.where(y == j + 1, db, 0) / p).sum()
        gw = np.bincount(cols, gs[rows] * values, SIZE) + decay * w / SIZE
        gf = np.concatenate([[gt.sum()], 2 * free[1:] * np.cumsum(gt[::-1])[::-1][1:]])
        for x, g, m, v in ((w, gw, state[0], state[1]), (free, gf, state[2], state[3])):
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return OrdinalModel(grades, w, free[0] + np.concatenate([[0.0], np.cumsum(free[1:] ** 2)]))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        raw = utf8(pdf["text"])
        for a, b in chunks(raw):
            code, at = gram_codes(raw[a:b])
            shape = shapes(raw[a:b])
            cols, values = [], []
            for i in range(b - a):
                c, v = np.unique(code[at[i] : at[i + 1]], return_counts=True)
                cols.append(np.concatenate([c, shape[i]]).astype(np.int32))
                values.append(np.concatenate([v / max(1, v.sum()), np.ones(len(SHAPES))]).astype(np.float32))
            yield pd.DataFrame({"id": pdf["id"].iloc[a:b].to_numpy(), "y": pdf["y"].iloc[a:b].to_numpy(), "cols": [c.tobytes() for c in cols], "vals": [v.tobytes() for v in values]})


def fit(docs: DataFrame, ratings: DataFrame, grade_col: str = "quality", per_grade: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Train on about per_grade documents of each grade."""
    small_batches(docs.sparkSession)
    y = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("long").alias("y")).groupBy("id").agg(F.max("y").alias("y")).filter("y IS NOT NULL")
    sizes = {r[0]: r[1] for r in y.groupBy("y").count().collect()}  # a row a grade
    grades = sorted(sizes)
    if len(grades) < 2:
        return OrdinalModel(grades or [0], np.zeros(SIZE), np.zeros(0))
    share = F.create_map(*(F.lit(v) for g in grades for v in (g, min(1.0, per_grade / sizes[g]))))
    drawn = y.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < share[F.col("y")] * (1 << 30))
    kind = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # About per_grade ids for each grade: a bounded side.
    held = thin.join(F.broadcast(drawn), "id").mapInPandas(tidy(_counts), f"id {kind}, y long, cols binary, vals binary").orderBy("id").toPandas()
    if held["y"].nunique() < 2:  # labels without documents
        return OrdinalModel(sorted(held["y"].astype(int).unique().tolist()) or [0], np.zeros(SIZE), np.zeros(0))
    cols = [np.frombuffer(c, dtype=np.int32) for c in held["cols"]]
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    values = np.concatenate([np.frombuffer(v, dtype=np.float32) for v in held["vals"]]).astype(np.float64)
    grades = sorted(held["y"].astype(int).unique().tolist())
    return fit_ordinal(rows, np.concatenate(cols), values, np.searchsorted(grades, held["y"].to_numpy()), grades)


def score_quality(docs: DataFrame, model: OrdinalModel, tail_grade: int | None = None, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, expected_grade, tail_probability (of tail_grade, by default the highest, or more) and kept (from keep_from on)."""
    small_batches(docs.sparkSession)
    get = shared(docs.sparkSession, model)  # a fixed size
    top = model.grades[-1] if tail_grade is None else tail_grade
    below = sum(g < top for g in model.grades)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = get()
        gaps = np.diff(np.asarray(m.grades, dtype=float))
        for texts in batches:
            p = m.above(m.scores(utf8(texts)))
            tail = p[:, below - 1] if 0 < below <= p.shape[1] else np.full(len(p), 1.0 if below == 0 or not p.shape[1] else 0.0)
            yield pd.DataFrame({"expected_grade": m.grades[0] + p @ gaps, "tail_probability": tail})

    q = F.pandas_udf(tidy(score), "expected_grade double, tail_probability double")(F.col(text_col))
    return docs.select(F.col(id_col), q.alias("q")).select(id_col, "q.expected_grade", "q.tail_probability", (F.col("q.tail_probability") >= keep_from).alias("kept"))
