"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is its hashed word vector, beside two character inputs: the mean of its hashed 4-byte grams' vectors (the gram that
starts at the space before the word marks its front), and the sum of its hashed prefixes' vectors by FRONT_PART.  One recurrent pass runs forward, one backward over windows of WINDOW words
that overlap by WINDOW - STRIDE; attention pools the states, a logistic layer scores the pool, and a document's score is
that of its highest window.  Every window of the whole text is scored.

The network is trained in numpy in one executor task on a bounded sample (about 1000 toxic and 2500 other documents, whole texts, of
SAMPLE_BYTES together at most), by labels of the training part only: rows whose crc32(doc_id as text) mod 3 is not 1.  Each step takes the highest window of some toxic
documents, and the highest and a random window of some others.  Labels, language, source and id are never inputs.

Null and empty texts: the score of a window without words.  A table without labels of both kinds gives a model that accepts everything
(score 0).  Labels of a document with both values, or null, count as toxic if any is 1; unlabelled documents aren't learned from.  Repeated
rows are scored alike.  Empty table: empty result.  Words are runs outside ASCII white space, A-Z lower-cased.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import BYTE_VALUES, byte_powers, chunks, mix64, release, shared, small_batches, tidy, utf8, word_spans

WINDOW, STRIDE = 32, 24
WORD_BITS, GRAM_BITS, FRONT_BITS = 14, 16, 16
WORD_DIM, GRAM_DIM, FRONT_DIM, HIDDEN = 4, 4, 4, 8
DIM = WORD_DIM + GRAM_DIM + FRONT_DIM
#: Bytes of the prefixes.
FRONTS = (4, 5, 6, 7, 8, 9, 10, 12)
#: The prefixes' vectors add up to a word's, divided by this.
FRONT_PART = 2
THRESHOLD = 0.7
#: Roots of a likelihood ratio up to this are taken for chance; the vectors learn at this part of the rate.
SURE = 3.5
SLOW = 0.02
#: While learning, this share of words is blanked, and noise of this size is added to the inputs.
BLANK, NOISE = 0.1, 0.2
#: What a toxic window weighs against another one.
POSITIVE = 2.5
#: Bytes of text that training takes at most; a text beyond what is left of them isn't learned from.
SAMPLE_BYTES = 48_000_000
STEP_BYTES = 600_000
STEP_WINDOWS = 2048
F32 = np.float32


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Words:
    """The words of some texts (or windows): word buckets, gram buckets with their first index for each word, prefix buckets, first word of each text."""

    word: np.ndarray
    gram: np.ndarray
    gram_at: np.ndarray
    front: np.ndarray  # (word, prefix); a word shorter than a prefix has its whole in its place
    text_at: np.ndarray


def read_words(texts: Sequence[bytes]) -> Words:
    raw = b"\n" + b"\n ".join(texts).lower() + b"\n   "  # two marks: the gram of a last word of one byte ends before the next text
    buf = np.frombuffer(raw, dtype=np.uint8)
    plain = np.where((buf >= 9) & (buf <= 13), 32, buf).astype(np.uint32)  # all white space is one mark
    starts, ends = word_spans(buf)
    c = plain[:-3] * np.uint32(0x9E3779B1) + plain[1:-2] * np.uint32(0x85EBCA77) + plain[2:-1] * np.uint32(0xC2B2AE3D) + plain[3:] * np.uint32(0x27D4EB2F)
    c ^= c >> np.uint32(15)
    c *= np.uint32(0x2C1B3C6D)
    code = (c >> np.uint32(32 - GRAM_BITS)).astype(np.uint16)
    # Grams of a word: from the space before it to the one that ends with it; at least one.
    n = np.maximum(ends - starts - 2, 1)
    gram_at = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=gram_at[1:])
    gram = code[np.repeat(starts - 1 - gram_at[:-1], n) + np.arange(gram_at[-1])]
    up, down = byte_powers(len(buf))
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[buf] * up[: len(buf)], out=total[1:])
    base, back = total[starts], down[starts]
    bucket = lambda to, bits: (mix64((total[to] - base) * back) >> np.uint64(64 - bits)).astype(np.uint16)
    word = bucket(ends, WORD_BITS)
    front = np.empty((len(starts), len(FRONTS)), dtype=np.uint16)
    for j, k in enumerate(FRONTS):
        front[:, j] = bucket(np.minimum(starts + k, ends), FRONT_BITS)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 2 for t in texts], out=at[1:])
    return Words(word, gram, gram_at, front, np.searchsorted(starts, at + 1))


def read_all_words(texts: Sequence[bytes]) -> Words:
    """read_words in steps of bounded size."""
    parts = [read_words(texts[a:b]) for a, b in chunks(texts, STEP_BYTES)]
    shifted = lambda arrays: np.concatenate([np.zeros(1, dtype=np.int64), *(np.diff(a) for a in arrays)]).cumsum()
    return Words(
        np.concatenate([p.word for p in parts]),
        np.concatenate([p.gram for p in parts]),
        shifted([p.gram_at for p in parts]),
        np.concatenate([p.front for p in parts]),
        shifted([p.text_at for p in parts]),
    )


def windows(text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of all windows; a text without words has one window of none."""
    n = np.diff(text_at)
    count = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = nth * STRIDE
    return text_at[text] + first, np.minimum(WINDOW, n[text] - first), text


def picked(w: Words, first: np.ndarray, length: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of some windows alone, one window after the other, and each window's first word there."""
    at = np.cumsum(length) - length
    rows = np.repeat(first - at, length) + np.arange(length.sum())
    n = np.diff(w.gram_at)[rows]
    gram_at = np.concatenate([[0], np.cumsum(n)])
    gram = w.gram[np.repeat(w.gram_at[rows] - gram_at[:-1], n) + np.arange(gram_at[-1])]
    return Words(w.word[rows], gram, gram_at, w.front[rows], np.append(at, len(rows))), at


@dataclass
class Model:
    """Weights; gates are stacked as update, reset, candidate."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    trained: bool = False

    @staticmethod
    def fresh(seed: int) -> Model:
        r = np.random.default_rng(seed)
        p = {"word": r.normal(0, 0.05, (1 << WORD_BITS, WORD_DIM)), "gram": r.normal(0, 0.05, (1 << GRAM_BITS, GRAM_DIM)), "front": r.normal(0, 0.05, (1 << FRONT_BITS, FRONT_DIM))}
        for d in "fb":
            p[f"w{d}"] = r.normal(0, 0.4, (DIM, 3 * HIDDEN))
            p[f"u{d}"] = r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
            p[f"c{d}"] = np.concatenate([np.full(HIDDEN, -1.0), np.zeros(2 * HIDDEN)])
        p |= {"att": r.normal(0, 0.3, 2 * HIDDEN), "out": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.array([-1.0])}
        return Model({k: v.astype(F32) for k, v in p.items()})

    def inputs(self, w: Words) -> np.ndarray:
        """A row a word, and one of zeros at last for padding."""
        x = np.zeros((len(w.word) + 1, DIM), dtype=F32)
        x[:-1, :WORD_DIM] = self.p["word"][w.word]
        if len(w.word):
            for j in range(GRAM_DIM):
                x[:-1, WORD_DIM + j] = np.add.reduceat(np.ascontiguousarray(self.p["gram"][:, j])[w.gram], w.gram_at[:-1])
            x[:-1, WORD_DIM : WORD_DIM + GRAM_DIM] /= np.diff(w.gram_at).astype(F32)[:, None]
            for j in range(len(FRONTS)):
                x[:-1, WORD_DIM + GRAM_DIM :] += self.p["front"][w.front[:, j]]
            x[:-1, WORD_DIM + GRAM_DIM :] /= FRONT_PART
        return x

    def states(self, x: np.ndarray, place: np.ndarray, length: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (step, window, 2 * HIDDEN) of windows given as rows of x (step, window)."""
        steps, n = place.shape
        out = np.zeros((steps, n, 2 * HIDDEN), dtype=F32)
        for d, order, part in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, None))):
            gates = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
            u = self.p[f"u{d}"]
            h = np.zeros((n, HIDDEN), dtype=F32)
            for t in order:
                g = gates[place[t]]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
                new = h + z * (c - h)
                if (length <= t).any():
                    new *= (length > t)[:, None]
                if keep is not None:
                    keep.append((d, t, h, z, r, c))
                h = new
                out[t, :, part] = h
        return out

    def pooled(self, states: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = states @ self.p["att"]
        a = np.where(np.arange(len(a))[:, None] < length, a, -1e9)
        a = np.exp(a - a.max(axis=0))
        a *= np.arange(len(a))[:, None] < length
        a /= np.maximum(a.sum(axis=0), 1e-9)
        return np.einsum("tn,tnh->nh", a, states), a

    def logits(self, x: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), dtype=F32)
        for k in range(0, len(first), STEP_WINDOWS):
            n = length[k : k + STEP_WINDOWS]
            place = placed(first[k : k + STEP_WINDOWS], n, len(x) - 1)
            pool, _ = self.pooled(self.states(x, place, n), n)
            out[k : k + STEP_WINDOWS] = pool @ self.p["out"] + self.p["bias"]
        return out

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        """A score for each text: the highest of its windows."""
        if not self.trained:
            return np.zeros(len(texts))
        out = np.empty(len(texts))
        for a, b in chunks(texts, STEP_BYTES):
            w = read_words(texts[a:b])
            first, length, text = windows(w.text_at)
            z = self.logits(self.inputs(w), first, length)
            out[a:b] = np.maximum.reduceat(z, np.searchsorted(text, np.arange(b - a)))
        return _sigmoid(out)

    def gradients(self, w: Words, x: np.ndarray, first: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Backpropagation through time for the mean logistic loss; the windows share no word."""
        n = len(first)
        place = placed(first, length, len(x) - 1)
        keep: list = []
        h = self.states(x, place, length, keep)
        pool, a = self.pooled(h, length)
        s = _sigmoid(pool @ self.p["out"] + self.p["bias"])
        loss = -float(np.mean(np.log(np.where(y == 1, s, 1 - s) + 1e-9)))
        dz = ((s - y) * np.where(y == 1, POSITIVE, 1) / n).astype(F32)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram", "front")}
        g["out"], g["bias"] = pool.T @ dz, np.array([dz.sum()], dtype=F32)
        dpool = dz[:, None] * self.p["out"]
        da = np.einsum("nh,tnh->tn", dpool, h)
        de = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", de, h)
        dh_all = a[:, :, None] * dpool + de[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        carry = {d: np.zeros((n, HIDDEN), dtype=F32) for d in "fb"}
        for d, t, h0, z, r, c in reversed(keep):
            u = self.p[f"u{d}"]
            dh = (dh_all[t][:, :HIDDEN] if d == "f" else dh_all[t][:, HIDDEN:]) + carry[d]
            dh = dh * (length > t)[:, None]
            dc = dh * z * (1 - c * c)
            drh = dc @ u[:, 2 * HIDDEN :].T
            dgates = np.concatenate([dh * (c - h0) * z * (1 - z), drh * h0 * r * (1 - r), dc], axis=1)
            g[f"u{d}"][:, : 2 * HIDDEN] += h0.T @ dgates[:, : 2 * HIDDEN]
            g[f"u{d}"][:, 2 * HIDDEN :] += (r * h0).T @ dc
            g[f"w{d}"] += x[place[t]].T @ dgates
            g[f"c{d}"] += dgates.sum(axis=0)
            carry[d] = dh * (1 - z) + drh * r + dgates[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
            dx[place[t]] += dgates @ self.p[f"w{d}"].T  # a row's step is its own; padding gets nothing
        rows = np.unique(place)
        rows = rows[rows < len(x) - 1]
        g["word"] = (w.word[rows], dx[rows, :WORD_DIM])
        counts = np.diff(w.gram_at)[rows]
        spots = np.repeat(w.gram_at[rows] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        g["gram"] = (w.gram[spots], np.repeat(dx[rows, WORD_DIM : WORD_DIM + GRAM_DIM] / counts[:, None], counts, axis=0))
        g["front"] = (w.front[rows].ravel(), np.repeat(dx[rows, WORD_DIM + GRAM_DIM :] / FRONT_PART, len(FRONTS), axis=0))
        return g, loss


def placed(first: np.ndarray, length: np.ndarray, pad: int) -> np.ndarray:
    """Rows of the input, (step, window); steps after a window's end point at the padding row."""
    t = np.arange(max(1, int(length.max()) if len(length) else 1))[:, None]
    return np.where(t < length, first + t, pad)


def train(texts: Sequence[bytes], y: np.ndarray, seed: int = 3, updates: int = 180, batch: int = 64, rate: float = 0.02) -> Model:
    """Adam steps on windows of a bounded set of labelled texts; the vectors' first coordinates start at how surely they tell the labels apart."""
    model = Model.fresh(seed)
    if not len(y) or y.min() == y.max():
        return model
    model.trained = True
    r = np.random.default_rng(seed)
    w = read_all_words(texts)
    _start_vectors(model, w, y)
    first, length, text = windows(w.text_at)
    owned = np.searchsorted(text, np.arange(len(texts) + 1))
    good, bad = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    top, worst = np.zeros(0), good
    for step in range(updates):
        if step % 30 == 0:  # find each document's highest window again; at first that with the surest word
            z = np.empty(len(first), dtype=F32)
            for k in range(0, len(first), STEP_WINDOWS):
                part, at = picked(w, first[k : k + STEP_WINDOWS], length[k : k + STEP_WINDOWS])
                rank = model.logits if step else _surest
                z[k : k + STEP_WINDOWS] = rank(model.inputs(part), at, length[k : k + STEP_WINDOWS])
            top = np.lexsort((z, text))[owned[1:] - 1]
            worst = good[np.argsort(-z[top[good]])[: max(1, len(good) // 5)]]
        some, other, spare = r.choice(bad, batch), r.choice(worst, batch), r.choice(good, batch)
        take = np.concatenate([top[some], top[other], top[spare], owned[spare] + (r.random(batch) * np.diff(owned)[spare]).astype(np.int64)])
        goal = (np.arange(len(take)) < batch).astype(F32)
        part, at = picked(w, first[take], length[take])
        x = model.inputs(part)
        x[:-1] *= r.random((len(x) - 1, 1)) > BLANK
        x[:-1] += r.normal(0, NOISE, (len(x) - 1, DIM))
        grads, _ = model.gradients(part, x.astype(F32), at, length[take], goal)
        now = rate * (1 - step / (updates + 1))
        for k, g in grads.items():
            m, v = state[k]
            if isinstance(g, tuple):
                at, inv = np.unique(g[0], return_inverse=True)
                total = np.zeros((len(at), g[1].shape[1]), dtype=F32)
                np.add.at(total, inv, g[1])
                m[at], v[at] = 0.9 * m[at] + 0.1 * total, 0.99 * v[at] + 0.01 * total * total
                model.p[k][at] -= SLOW * now * m[at] / (np.sqrt(v[at]) + 1e-6)
            else:
                m[:], v[:] = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                model.p[k] -= now * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-6)
    return model


def _surest(x: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    sure = x[:, 0] + x[:, WORD_DIM] + x[:, WORD_DIM + GRAM_DIM]
    return sure[placed(first, length, len(x) - 1)].max(axis=0)


def _start_vectors(model: Model, w: Words, y: np.ndarray) -> None:
    counts = {k: [np.zeros(len(model.p[k]), dtype=np.int64) for _ in range(2)] for k in ("word", "front", "gram")}
    for i in range(0, len(y), 200):
        j = min(len(y), i + 200)
        words = slice(w.text_at[i], w.text_at[j])
        doc = np.repeat(np.arange(i, j), np.diff(w.text_at[i : j + 1]))
        grams = np.repeat(doc, np.diff(w.gram_at[w.text_at[i] : w.text_at[j] + 1]))
        for name, code, owner in (("word", w.word[words], doc), ("front", w.front[words].ravel(), np.repeat(doc, len(FRONTS))), ("gram", w.gram[w.gram_at[w.text_at[i]] : w.gram_at[w.text_at[j]]], grams)):
            pairs = np.unique(owner.astype(np.int64) * len(model.p[name]) + code)
            toxic = y[pairs // len(model.p[name])] == 1
            for pick, total in zip((toxic, ~toxic), counts[name], strict=True):
                total += np.bincount(pairs[pick] % len(model.p[name]), minlength=len(total))
    for name, (a, b) in counts.items():
        # Signed root of the log-likelihood ratio against the share of toxic documents: a bucket seen in few documents says little.
        n, p = a + b, (y == 1).mean()
        g = 2 * (a * np.log(np.maximum(a, 1e-9) / np.maximum(n * p, 1e-9)) + b * np.log(np.maximum(b, 1e-9) / np.maximum(n * (1 - p), 1e-9)))
        root = np.sqrt(np.maximum(g, 0))
        model.p[name][:, 0] = np.sign(a - n * p) * np.clip((root - SURE) / 2, 0, 2)


def _train_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task: the sample in the order it comes in, up to SAMPLE_BYTES of text; a row for each weight of the model."""
    texts, y, left = [], [], SAMPLE_BYTES
    for pdf in batches:
        for t, label in zip(utf8(pdf["text"]), pdf["y"], strict=True):
            if len(t) <= left:
                left -= len(t)
                texts.append(t)
                y.append(label)
    model = train(texts, np.array(y, dtype=np.int64))
    names = sorted(model.p) if model.trained else []
    yield pd.DataFrame({"name": names, "shape": [list(model.p[k].shape) for k in names], "weights": [model.p[k].astype(F32).tobytes() for k in names]}, dtype=object)


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 1000, other: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most about that many toxic and other labelled documents, drawn by a hash of the id, in one executor task.

    The driver gets only the weights (2.4 MB)."""
    small_batches(docs.sparkSession)
    y = labels.select(F.col(id_col).alias("id"), F.col("toxic")).groupBy("id").agg(F.max("toxic").alias("y")).filter("y IN (0, 1)")
    y = y.filter(~held_out("id"))
    sizes = {r[0]: r[1] for r in y.groupBy("y").count().collect()}  # two rows
    if len(sizes) < 2:
        return Model.fresh(0)
    share = F.when(F.col("y") == 1, F.lit(toxic / sizes[1])).otherwise(F.lit(other / sizes[0]))
    order = F.xxhash64("id", F.lit(11))
    drawn = y.filter(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30))
    # About toxic + other ids at most: a bounded side, and a bounded number of texts in the one task.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    rows = rows.repartition(1).sortWithinPartitions(order, "id", "text").select("text", F.col("y").cast("long").alias("y"))
    held = rows.mapInPandas(tidy(_train_task), "name string, shape array<long>, weights binary").collect()
    model = Model({r[0]: np.frombuffer(r[2], dtype=F32).reshape(r[1]) for r in held}, True) if held else Model.fresh(0)
    release(docs.sparkSession)
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score column of a document's text; the broadcast model has a fixed size."""
    small_batches(docs.sparkSession)
    get = shared(docs.sparkSession, model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = get()
        for texts in batches:
            yield pd.Series(held.scores(utf8(texts)), dtype="float64")

    return F.pandas_udf(tidy(score), "double")(F.col(text_col))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted (1 from THRESHOLD on) of every document."""
    score = scored(docs, model, text_col)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score.alias("score")).select(
        id_col, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that the model doesn't reject, with all their columns."""
    score = scored(docs, model, text_col)
    return docs.withColumn("__tox_score", score).filter(F.col("__tox_score") < THRESHOLD).drop("__tox_score")


def crc_part(doc_id: int) -> int:
    """The remainder that decides whether a document is held out."""
    return zlib.crc32(str(doc_id).encode()) % 3
