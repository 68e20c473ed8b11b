"""Shared pieces: lineage cuts in the shared folder, bounded text chunks, vectorised word hashes.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, A-Z lower-cased
where stated.  All hashes are fixed functions of their input: reruns and retried tasks agree.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import brindle

# Python workers get these functions by value: no package has to be installed on the executors (objects go by `shared`).
cloudpickle.register_pickle_by_value(brindle)

#: The white space of words, as a Java, Python and DuckDB character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one vectorised step works on; one longer document makes a step of its own.
CHUNK_BYTES = 1_000_000

#: Bits of a filter of hashes: so many for each hash, within these powers of two (pieces of 2 KB, 8 MB in all at most).
BITS_EACH, LEAST_BITS, MOST_BITS, PIECE = 16, 20, 26, 1 << 14

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared checkpoint folder (a temporary one only where it is unset and all runs on one machine)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/brindle-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later stages don't depend on lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value):
    """Broadcast an object of bounded size; the result gives it to a task.  It goes by value, class and all, so workers need no package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        return pickle.loads(sent.value)

    return get


def marked_by(rows: DataFrame, key, wanted: DataFrame, wanted_key, count: int) -> DataFrame:
    """rows with __maybe: false only where no row of wanted (about count rows) has the same long key.

    A bitmap of the keys' places is broadcast, so that a join with wanted need not shuffle what can't meet it; it never grows
    beyond 2^MOST_BITS bits, where more rows pass than need to.
    """
    bits = 1 << min(max((count * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)
    at = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    places = wanted.select(at(wanted_key).alias("__at")).withColumn("__piece", F.expr(f"__at div {PIECE}"))
    # Dealt by piece first: a piece is made in one task, and places are shuffled, not bitmaps of each task.
    pieces = places.repartition("__piece").groupBy("__piece").agg(F.expr(f"substring(bitmap_construct_agg(__at % {PIECE}), 1, {PIECE // 8})").alias("__bits"))
    rows = rows.withColumn("__at", at(key)).withColumn("__piece", F.expr(f"__at div {PIECE}")).join(F.broadcast(pieces), "__piece", "left")
    byte = f"CAST(conv(hex(substring(__bits, CAST(__at % {PIECE} div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    held = F.expr(f"coalesce(shiftright({byte}, CAST(__at % 8 AS INT)) & 1, 0) = 1")
    return rows.withColumn("__maybe", held).drop("__at", "__piece", "__bits")


def small_batches(spark: SparkSession, most: int = 16 * 2**20) -> None:
    """Hand texts to Python workers in batches of at most 16 MB (the session's setting, if that is smaller): a worker holds one or two."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"[^0-9-]", "", spark.conf.get(key))) not in range(1, most + 1):
        spark.conf.set(key, str(most))


def _trim() -> None:
    """Free garbage, and hand freed memory back to the system where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task):
    """A task's generator that leaves nothing behind: Python workers are used again, and each task brings its own copy of the functions
    (and of what they have cached), which would otherwise wait for a full collection."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            _cache.clear()
            _trim()

    return run


def release(spark: SparkSession) -> None:
    """Give back what finished steps hold: freed memory of the driver, and shuffle files and broadcasts that nothing uses any more
    (Spark drops those only when the driver's JVM collects garbage)."""
    _trim()
    spark.sparkContext._jvm.System.gc()


def chunks(texts: Sequence[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Half-open row ranges that hold about limit bytes each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_cache: dict[str, np.ndarray] = {}


def byte_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n."""
    held = _cache.get("p")
    if held is None or len(held) < n:
        size = max(n, CHUNK_BYTES + CHUNK_BYTES // 4)
        if size > 4 * CHUNK_BYTES:  # one huge document: not kept
            return _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))
        _cache["p"], _cache["q"] = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
    return _cache["p"], _cache["q"]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in a byte buffer."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside))
    return edge[0::2], edge[1::2]


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the index of each text's first word (with the end at last)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts, ends = word_spans(buf)
    up, down = byte_powers(len(buf))
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[buf] * up[: len(buf)], out=total[1:])
    h = mix64((total[ends] - total[starts]) * down[starts])
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return h, np.searchsorted(starts, at)


def utf8(values) -> list[bytes]:
    """UTF-8 bytes of a column's texts; null is empty."""
    return [b"" if v is None or v != v else v.encode("utf-8", "surrogatepass") for v in values]
