"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Rows get a reproducible global number 0..N-1, a keyed Feistel network on Z_a x Z_b (a*b just over N)
permutes the numbers, and values outside 0..N-1 walk on until they come back.  Permuted number p lies in
shard p mod S at slot p div S, so shard counts differ by at most one and slots have no gaps.  `locate` and
`row_at` compute shard and slot of a row number, and the reverse, without data.

DataFrame and SQL expressions only.  Numbers come from a hash bucket's offset plus the rank in the bucket:
one shuffle of thin rows, no global sort.  Repeated rows are counted before that shuffle and
expanded after it, so copies of one row never meet in one task.

`shard_in_order` numbers the rows as they stand in the files that docs were read from, and keeps their columns: after a sort by range,
the row number is the place in that order, and shard and slot follow from it.  It needs no shuffle at all.

Null text: size 1, checksum 0.  Null ids number like any other value.  Empty table: empty result.
Ties (rows equal in id, size and checksum) are alike and take neighbouring numbers.  Other columns of the input
are not read, whatever their names.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut

ROUNDS = 4


#: Copies of one row that one task writes.
COPIES = 100_000


def _shape(n: int) -> tuple[int, int, int]:
    """a, b and the most walks: a row leaves 0..N-1 with chance < 1/b, and at most a*b - N values lie outside."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    return a, b, min(a * b - n, 40)  # more than 40 only if b > 40: then a row needs more walks with chance < 1e-60


def _feistel(x: str, n: int, seed: int) -> str:
    a, b, walks = _shape(n)
    keys = ", ".join(f"{seed * 1000 + k}L" for k in range(ROUNDS))
    left = f"pmod(s.l + pmod(xxhash64(s.r, 2 * k), {a}L), {a}L)"
    once = lambda v: (
        f"aggregate(array({keys}), named_struct('l', {v} % {a}L, 'r', {v} div {a}L), "
        f"(s, k) -> named_struct('l', {left}, 'r', pmod(s.r + pmod(xxhash64({left}, 2 * k + 1), {b}L), {b}L)), "
        f"s -> s.r * {a}L + s.l)"
    )
    if not walks:
        return once(x)
    return f"aggregate(sequence(1, {walks}), {once(x)}, (p, i) -> if(p < {n}L, p, {once('p')}))"


def _hash(x: int, k: int) -> int:
    h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42)
    h = xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def locate(row: int, n: int, shards: int, seed: int = 7) -> tuple[int, int]:
    """Shard and slot of a row number, as the DataFrame code computes them."""
    a, b, _ = _shape(n)
    p = row
    while True:
        left, right = p % a, p // a
        for k in range(seed * 1000, seed * 1000 + ROUNDS):
            left = (left + _hash(right, 2 * k) % a) % a
            right = (right + _hash(left, 2 * k + 1) % b) % b
        p = right * a + left
        if p < n:
            return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 7) -> int:
    """The row number that lies in this shard and slot."""
    a, b, _ = _shape(n)
    p = slot * shards + shard
    if not 0 <= p < n:
        raise ValueError("no row lies there")
    while True:
        left, right = p % a, p // a
        for k in reversed(range(seed * 1000, seed * 1000 + ROUNDS)):
            right = (right - _hash(left, 2 * k + 1) % b) % b
            left = (left - _hash(right, 2 * k) % a) % a
        p = right * a + left
        if p < n:
            return p


def shard_rows(
    docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 20_000
) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes + 1), text_crc32, law 'rows', row_number, shard, slot, grown_shard (null)."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    thin = cut(
        docs.select(F.col(id_col).alias("id"), (F.length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("crc"))
        .groupBy("id", "size", "crc")
        .agg(F.count("*").alias("copies")),
        "shard",
    )
    n, most = thin.agg(F.sum("copies"), F.max("copies")).first()
    n = n or 0
    # The count of buckets follows the rows: a bucket's window stays small at any size.
    buckets = max(16, 1 << (n // rows_per_bucket).bit_length())
    thin = thin.withColumn("bucket", F.expr(f"pmod(xxhash64(id, crc, size), {buckets})"))
    offsets = thin.groupBy("bucket").agg(F.sum("copies").alias("held"))
    return (
        _numbered(thin, offsets, buckets, (most or 0) > COPIES)
        .withColumn("p", F.expr(_feistel("row_number", max(n, 1), seed)))
        .select(F.col("id").alias(id_col), F.col("size").cast("long").alias("size"), F.col("crc").alias("text_crc32"), *_spot(shards), "row_number")
    )


def _spot(shards: int) -> list:
    return [
        F.lit("rows").alias("law"),
        (F.col("p") % shards).cast("int").alias("shard"),
        F.expr(f"p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    ]


def shard_in_order(docs: DataFrame, shards: int = 16, seed: int = 7, text_col: str = "text") -> DataFrame:
    """docs, read from Parquet files that Spark wrote, with size, text_crc32, law, row_number, shard, slot and grown_shard beside its columns.

    Rows are numbered by file (in order of the number in its name), then by place in the file: the order that the writer gave them.
    Columns of docs that clash with the new ones go."""
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number")
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    held = rows.groupBy("__file").agg(F.count("*").alias("held"))
    # Two numbers a file: small at any size.
    number = F.coalesce(F.regexp_extract("__file", r"part-(\d+)[^/]*$", 1).try_cast("long"), F.lit(-1))
    order = Window.orderBy("number", "__file").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(held.withColumn("number", number).withColumn("__base", F.coalesce(F.sum("held").over(order), F.lit(0))).select(F.xxhash64("__file").alias("__name"), "held", "__base"), "files")
    n = bases.agg(F.sum("held")).first()[0] or 0
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    out = rows.withColumn("__file", F.xxhash64("__file")).join(F.broadcast(bases), F.col("__file") == F.col("__name")).withColumn("row_number", F.col("__base") + F.col("__at"))
    out = out.withColumn("p", F.expr(_feistel("row_number", max(n, 1), seed)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    return out.select(*kept, (F.length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"), *_spot(shards), "row_number")


def _numbered(thin: DataFrame, held: DataFrame, buckets: int, spread: bool) -> DataFrame:
    """Adds row_number.  Bucket offsets are summed in two levels, so neither level meets in one task.

    spread: some row has very many copies; they are dealt in parts of COPIES."""
    spark = thin.sparkSession
    width = max(1, math.isqrt(buckets))
    spark_view = {"thin": thin, "held": held}
    ranked = spark.sql(
        f"""
        WITH h AS (SELECT bucket, held, bucket div {width} AS block FROM {{held}}),
        blocks AS (SELECT block, sum(held) AS held FROM h GROUP BY block),
        before AS (SELECT block, coalesce(sum(held) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM blocks),
        offsets AS (
            SELECT h.bucket, b.base + coalesce(sum(h.held) OVER (PARTITION BY h.block ORDER BY h.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
            FROM h JOIN before b ON h.block = b.block
        ),
        ranked AS (
            SELECT id, size, crc, copies, bucket,
                   coalesce(sum(copies) OVER (PARTITION BY bucket ORDER BY id, crc, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
            FROM {{thin}}
        )
        SELECT r.id, r.size, r.crc, o.base + r.first AS first, o.base + r.first + r.copies - 1 AS last
        FROM ranked r JOIN offsets o ON r.bucket = o.bucket
        """,
        **spark_view,
    )
    if spread:
        parts = ranked.withColumn("first", F.explode(F.expr(f"sequence(first, last, {COPIES}L)"))).withColumn("last", F.expr(f"least(last, first + {COPIES - 1})"))
        ranked = parts.repartition("first")
    return ranked.select("id", "size", "crc", F.explode(F.expr("sequence(first, last)")).alias("row_number"))
