"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A paragraph is a line, cut after sentence ends, so that one long line isn't one cell; its digest is 64 bits of BLAKE2b, and
a repeated paragraph counts once for each time it occurs.  A sketch adds every digest to one cell in each of three tables (count, sum
of digests, sum of checks).  The sketches of two versions subtract cell by cell; peeling then takes digests from cells that hold
exactly one until nothing is left.  If something is left, both are sketched again four times as large with other
hashes (after MAX_TRIES, the digests are compared directly).  likeness = (a + b - d) / (a + b + d) for a and b digests and d differing
ones: the Jaccard measure of the two sets; two empty texts are alike (1).

Null text: empty.  Empty text: an empty sketch.  Very long texts grow with themselves only.  Repeated rows and
repeated ids: ordered by id, then by a hash of the text; copies are alike.  Null ids come last.  Empty table: empty result.
Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import CHUNK_BYTES, cut, mix64, small_batches, tidy

TABLES = 3
CELLS = 18
GROWTH = 4
MAX_TRIES = 8
MOST_CELLS = 600_000
_U = np.uint64


def digests(text: str) -> np.ndarray:
    """Distinct digests of a text's paragraphs, the k-th occurrence of one counted apart."""
    parts = [p for p in text.replace(". ", ".\n").split("\n") if p]
    raw = b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8).digest() for p in parts])
    h = np.sort(np.frombuffer(raw, dtype="<u8").astype(np.uint64))
    if len(h) > 1 and (h[1:] == h[:-1]).any():
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
        h = h + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    return h


def _salt(n: int) -> np.uint64:
    return _U(n * 0xD6E8FEB86659FD93 % (1 << 64))


def _check(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix64(keys ^ _U(0xA5A5A5A5 + seed)) >> _U(32)


def _places(keys: np.ndarray, owner: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """For each key its cell in each table, among the cells of its owner."""
    part = cells // TABLES
    return np.stack([owner * cells + j * part + (mix64(keys + _salt(seed * TABLES + j + 1)) % _U(part)).astype(np.int64) for j in range(TABLES)])


class Sketches:
    """The sketches of several owners side by side."""

    def __init__(self, owners: int, cells: int, seed: int):
        self.owners, self.cells, self.seed = owners, cells, seed
        self.count = np.zeros(owners * cells, dtype=np.int64)
        self.keys = np.zeros(owners * cells, dtype=np.uint64)
        self.checks = np.zeros(owners * cells, dtype=np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        up = sign.astype(np.uint64)  # -1 wraps round, as the sums do
        checks = _check(keys, self.seed)
        for at in _places(keys, owner, self.cells, self.seed):
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, keys * up)
            np.add.at(self.checks, at, checks * up)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.owners, self.cells, self.seed)
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and sign (1: only in the first) of what differs, and whether each owner came out whole."""
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(4 * self.cells + 4):
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            up = sign.astype(np.uint64)
            keys = self.keys[at] * up
            pure = self.checks[at] * up == _check(keys, self.seed)
            at, sign, keys = at[pure], sign[pure], keys[pure]
            if not len(at):
                break
            owner = at // self.cells
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])])
            owner, keys, sign = owner[new], keys[new], sign[new]
            self.add(keys, owner, -sign)
            got.append((owner, keys, sign))
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        whole = ~left.reshape(self.owners, self.cells).any(axis=1)
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), whole
        return *(np.concatenate(x) for x in zip(*got, strict=True)), whole

    def packed(self, owner: int, n: int) -> bytes:
        at = slice(owner * self.cells, (owner + 1) * self.cells)
        raw = self.count[at].astype("<i4").tobytes() + self.keys[at].astype("<u8").tobytes() + self.checks[at].astype("<u4").tobytes()
        return n.to_bytes(4, "little") + raw


def _flat(sets: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return (np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)), owner


def sketch(sets: Sequence[np.ndarray], cells: int = CELLS, seed: int = 0) -> Sketches:
    keys, owner = _flat(sets)
    out = Sketches(len(sets), cells, seed)
    out.add(keys, owner, np.ones(len(keys), dtype=np.int64))
    return out


def differing(a: Sequence[np.ndarray], b: Sequence[np.ndarray], first: tuple[Sketches, Sketches] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets, what only the first and only the second holds, by subtracting and peeling."""
    out: list = [None] * len(a)
    todo, cells = np.arange(len(a)), CELLS
    for seed in range(MAX_TRIES):
        failed = []
        block = max(1, MOST_CELLS // cells)
        for k in range(0, len(todo), block):
            some = todo[k : k + block]
            x, y = first if first and not seed and len(some) == len(a) else (sketch([s[i] for i in some], cells, seed) for s in (a, b))
            owner, keys, sign, whole = x.minus(y).peel()
            ends = np.searchsorted(owner[order := np.argsort(owner, kind="stable")], np.arange(len(some) + 1))
            keys, sign = keys[order], sign[order]
            for j, i in enumerate(some):
                if whole[j]:
                    mine, signs = keys[ends[j] : ends[j + 1]], sign[ends[j] : ends[j + 1]]
                    out[i] = mine[signs > 0], mine[signs < 0]
                else:
                    failed.append(i)
        todo, cells = np.asarray(failed, dtype=np.int64), cells * GROWTH
        if not len(todo):
            return out
    for i in todo:
        out[i] = np.setdiff1d(a[i], b[i]), np.setdiff1d(b[i], a[i])
    return out


def likenesses(a: Sequence[np.ndarray], b: Sequence[np.ndarray], first: tuple[Sketches, Sketches] | None = None) -> list[float]:
    out = []
    for x, y, (more, less) in zip(a, b, differing(a, b, first), strict=True):
        n, d = len(x) + len(y), len(more) + len(less)
        out.append((n - d) / (n + d) if n + d else 1.0)
    return out


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the text's code points replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(ids: list, texts: list[str], sets: list[np.ndarray], after: list[str], after_sets: list[np.ndarray]) -> dict[str, list]:
    changed = [edited(t, n) for t, n in zip(texts, after, strict=True)]
    changed_sets = [digests(t) for t in changed]
    own, other, following = sketch(sets), sketch(changed_sets), sketch(after_sets)
    return {
        "id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [own.packed(i, len(s)) for i, s in enumerate(sets)],
        "edited_fingerprint": [other.packed(i, len(s)) for i, s in enumerate(changed_sets)],
        "near_edited": likenesses(sets, changed_sets, (own, other)),
        "near_next": likenesses(sets, after_sets, (own, following)),
    }


_RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document in descending id (after the last: the first).

    The texts are dealt by range of id and sorted, one shuffle; a task sees each neighbour pair but its last document's.
    Each task's first and last document are kept with the results, and only those are paired in a second, small step.
    """
    small_batches(docs.sparkSession)
    thin = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = thin.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {_RESULT}, role string, part int, text string"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None

        def edge(role: str, x: tuple) -> pd.DataFrame:
            return pd.DataFrame({"id": [x[0]], **{n: [None] for n in _NAMES[1:]}, "role": [role], "part": [part], "text": [x[1]]})

        for pdf in batches:
            ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
            rows: list[tuple] = []
            size = 0
            for x in zip(ids, texts, strict=True):
                row = (*x, digests(x[1]))
                if held is None:
                    yield edge("first", row)
                    held = row
                    rows.append(row)
                    continue
                if not rows:
                    rows.append(held)
                rows.append(row)
                held, size = row, size + len(row[1])
                if size > CHUNK_BYTES // 2:
                    yield paired(rows)
                    rows, size = [], 0
            if len(rows) > 1:
                yield paired(rows)
        if held is not None:
            yield edge("last", held)

    def paired(rows: list[tuple]) -> pd.DataFrame:
        ids, texts, sets = (list(x) for x in zip(*rows, strict=True))
        out = pd.DataFrame(_compare(ids[:-1], texts[:-1], sets[:-1], texts[1:], sets[1:]))
        return out.assign(role=None, part=None, text=None)

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.desc_nulls_last("id"), F.desc("h")]
    dealt = thin.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    done = cut(dealt.mapInPandas(tidy(task), schema), "fingerprint")

    edges = done.filter(F.col("role").isNotNull())
    numbers = sorted(r[0] for r in edges.filter("role = 'first'").select("part").collect())  # one number a task
    if not numbers:
        return _written(done, id_col)
    following = F.element_at(F.lit(numbers[1:] + numbers[:1]), F.array_position(F.lit(numbers), F.col("part")).cast("int"))
    last = edges.filter("role = 'last'").select("id", "text", following.alias("next_part"))
    first = edges.filter("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, after = pdf["text"].tolist(), pdf["next_text"].tolist()
            yield pd.DataFrame(_compare(pdf["id"].tolist(), texts, [digests(t) for t in texts], after, [digests(t) for t in after]))

    rest = last.join(first, "next_part").select("id", "text", "next_text").mapInPandas(tidy(tails), f"id {kind}, {_RESULT}")
    return _written(done.filter(F.col("role").isNull()).select(*_NAMES).unionByName(rest), id_col)


def _written(done: DataFrame, id_col: str) -> DataFrame:
    """The sketches as text, only now: the kept results stay a quarter smaller."""
    text = {n: F.translate(F.base64(n), "\r\n", "").alias(n) for n in ("fingerprint", "edited_fingerprint")}
    return done.select(F.col("id").alias(id_col), *(text.get(n, F.col(n)) for n in _NAMES[1:]))
