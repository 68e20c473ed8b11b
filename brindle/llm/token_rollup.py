"""Token counts: totals by source, language and tokenizer version, kept up to date by signed deltas.

A change row says that a document was inserted, deleted, or counted anew; it adds +tokens, -tokens or the difference to its
group.  A batch's changes are summed before they are kept (map-side first), so a hot group costs a row a task.
`commit` writes the batch's sums to a folder of its own, and then a marker for the batch that names this folder.  The marker is made only
if it isn't there (the file system decides that in one step), so a batch that is sent again, by several writers at once, or whose job
died halfway, counts exactly once.  `totals` adds the folders that markers name; `compact` reads the markers once, and folds exactly these
batches into a snapshot that lists them.  Batch ids may hold any characters.

Null text: no tokens (the document still counts).  Null source or language: a group of its own.  Repeated rows within a batch
count as often as they stand there.  Empty table: a committed batch with no rows.  Other columns of the input aren't read.
"""

from __future__ import annotations

import base64
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import small_batches, tidy

KEYS = ("source", "lang", "tokenizer")
#: Seconds after which an empty marker is taken for one of a writer that died.
ABANDONED = 600
#: Fixed value: the split pattern of the byte-level vocabulary.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A vocabulary file of base64 tokens and ranks, from any place that Spark reads."""
    lines = spark.read.text(path if "://" in path else f"file://{path}").collect()  # a vocabulary: some MB at most
    return {base64.b64decode(a): int(b) for a, b in (r[0].split() for r in lines if r[0].strip())}


def token_counts(docs: DataFrame, ranks: dict[bytes, int], version: str, pattern: str = BYTE_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, source, lang, tokenizer and tokens of each document: one row by the byte-pair vocabulary, one by words ('words-v1')."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: some MB at most

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encoding = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        for texts in batches:
            yield pd.Series([0 if t is None else len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    pieces = F.pandas_udf(tidy(count), "long")
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(
        F.col(id_col),
        F.col("source"),
        F.col("lang"),
        F.explode(
            F.array(
                F.struct(F.lit(version).alias("tokenizer"), pieces(F.col(text_col)).alias("tokens")),
                F.struct(F.lit("words-v1").alias("tokenizer"), words.alias("tokens")),
            )
        ).alias("c"),
    ).select(id_col, "source", "lang", "c.tokenizer", "c.tokens")


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit("insert").alias("op"), F.lit(0).cast("long").alias("old_tokens"), "tokens")


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit("delete").alias("op"), F.lit(0).cast("long").alias("old_tokens"), "tokens")


def revisions(counted: DataFrame, old_tokens: str) -> DataFrame:
    """Documents whose count was old_tokens (a column) and is tokens now."""
    return counted.select(*KEYS, F.lit("revise").alias("op"), F.col(old_tokens).cast("long").alias("old_tokens"), "tokens")


class TokenRollup:
    """Totals in a folder that all executors share."""

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        at = self._path(f"{self.path}/{kind}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if not s.getPath().getName().startswith(".")) if self._fs.exists(at) else []

    def _read(self, kind: str, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{kind}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _mark(self, kind: str, name: str, folder: str) -> bool:
        """Make the marker, if it isn't there.  An empty one is another writer's that is about to be filled, or, after a while, of one that died."""
        at = self._path(f"{self.path}/{kind}/{name}")
        if self._fs.exists(at):
            status = self._fs.getFileStatus(at)
            if status.getLen() or time.time() - status.getModificationTime() / 1000 < ABANDONED:
                return False
            self._fs.delete(at, False)
        self._fs.mkdirs(at.getParent())
        try:
            stream = self._fs.create(at, False)
        except Py4JJavaError:
            if not self._fs.exists(at):
                raise
            return False
        stream.write(folder.encode())
        stream.close()
        return True

    def _markers(self) -> dict[str, str]:
        """Marker name and folder of all committed batches that no snapshot has folded."""
        held = {n: self._read("commits", n) for n in self._names("commits")}
        return {n: folder for n, folder in held.items() if folder}

    def _snapshot(self) -> str | None:
        """The folder of the last snapshot."""
        held = [folder for n in self._names("snapshots") if (folder := self._read("snapshots", n))]
        return held[-1] if held else None

    def _folded(self, at: str | None, name: str | None = None) -> DataFrame:
        """Marker names that the snapshot at this folder lists, or whether name is one of them."""
        held = self.spark.read.schema("batch string").parquet(f"{self.path}/{at}/batches") if at else self.spark.createDataFrame([], "batch string")
        return held if name is None else held.filter(F.col("batch") == name)

    def committed(self) -> set[str]:
        """The ids of all committed batches."""
        names = {r[0] for r in self._folded(self._snapshot()).collect()} | set(self._markers())
        return {base64.urlsafe_b64decode(n.encode()).decode() for n in names}

    def _has(self, name: str) -> bool:
        return name in self._markers() or bool(self._folded(self._snapshot(), name).count())

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply changes (source, lang, tokenizer, op: insert, delete or revise, old_tokens, tokens) once.  False: it was there already."""
        name = base64.urlsafe_b64encode(batch_id.encode()).decode()
        if self._has(name):
            return False
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
        delta = F.when(F.col("op") == "revise", F.col("tokens") - F.col("old_tokens")).otherwise(sign * F.col("tokens"))
        sums = changes.select(*KEYS, sign.cast("long").alias("n"), delta.cast("long").alias("t")).groupBy(*KEYS).agg(F.sum("n").alias("n_docs"), F.sum("t").alias("n_tokens"))
        folder = f"data/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{folder}")
        # A compaction may have folded the same batch of another writer meanwhile: its marker stays until the snapshot lists it.
        if self._mark("commits", name, folder):
            if not self._folded(self._snapshot(), name).count():
                return True
            self._fs.delete(self._path(f"{self.path}/commits/{name}"), False)
        self._fs.delete(self._path(f"{self.path}/{folder}"), True)
        return False

    def _sums(self, at: str | None, markers: dict[str, str]) -> DataFrame:
        paths = ([f"{self.path}/{at}/totals"] if at else []) + [f"{self.path}/{folder}" for folder in markers.values()]
        held = self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)
        return held.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")

    def _state(self) -> tuple[str | None, dict[str, str]]:
        """The last snapshot and the markers of batches that it doesn't list.  Markers are read first: one that goes in between is in the snapshot."""
        markers, at = self._markers(), self._snapshot()
        listed = {r[0] for r in self._folded(at).filter(F.col("batch").isin(*markers)).collect()} if markers else set()
        return at, {n: f for n, f in markers.items() if n not in listed}

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups whose documents are all deleted go."""
        return self._sums(*self._state())

    def compact(self) -> bool:
        """Fold the batches committed so far into the next snapshot; then their markers and folders go.  False: another compaction was first."""
        number, (at, markers) = len(self._names("snapshots")), self._state()
        folder = f"data/{uuid.uuid4().hex}"
        self._sums(at, markers).write.parquet(f"{self.path}/{folder}/totals")
        self._folded(at).union(self.spark.createDataFrame([(n,) for n in markers], "batch string")).write.parquet(f"{self.path}/{folder}/batches")
        if not self._mark("snapshots", f"{number:08d}", folder):
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            return False
        for name, old in markers.items():
            self._fs.delete(self._path(f"{self.path}/commits/{name}"), False)
            self._fs.delete(self._path(f"{self.path}/{old}"), True)
        return True
