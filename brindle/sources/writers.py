"""Sinks: CSV and Parquet folders or single files, previews, codec comparison and safe overwrites."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources import files

CODECS = ("snappy", "gzip", "lz4", "zstd", "none")


def write_csv(df: DataFrame, path: str, delimiter: str = ",", include_header: bool = True, quote_all: bool = False, date_format: str | None = None, null_value: str = "", encoding: str = "UTF-8", single_file: bool = False) -> str:
    """A folder of part files, or one file (small results: one task writes it)."""
    w = (df.coalesce(1) if single_file else df).write.mode("overwrite").option("sep", delimiter).option("header", include_header).option("quoteAll", quote_all).option("nullValue", null_value).option("emptyValue", "").option("encoding", encoding)
    if date_format:
        w = w.option("dateFormat", date_format)
    return _single(df, w.csv, path) if single_file else (w.csv(path), path)[1]


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", row_group_bytes: int | None = None, statistics: bool = True, single_file: bool = False) -> str:
    w = (df.coalesce(1) if single_file else df).write.mode("overwrite").option("compression", compression)
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    if not statistics:
        w = w.option("parquet.column.statistics.enabled", "false")
    return _single(df, w.parquet, path) if single_file else (w.parquet(path), path)[1]


def _single(df: DataFrame, write, path: str) -> str:
    folder = f"{path}.{uuid.uuid4().hex}"
    write(folder)
    files.move(df.sparkSession, f"{folder}/{next(iter(files.parts(df.sparkSession, folder)))}", path)
    files.remove(df.sparkSession, folder)
    return path


def write_many(frames: dict[str, DataFrame], folder: str, kind: str = "parquet") -> dict[str, str]:
    """Each table in a folder of its own, named after it."""
    write = {"parquet": write_parquet, "csv": write_csv}[kind]
    return {name: write(df, f"{folder}/{name}.{kind}") for name, df in frames.items()}


def preview_csv(df: DataFrame, rows: int = 5, delimiter: str = ",") -> list[str]:
    """The header and first rows as CSV lines."""
    line = F.concat_ws(delimiter, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns))
    return [delimiter.join(df.columns), *(r[0] for r in df.limit(rows).select(line).collect())]


def compare_codecs(df: DataFrame, folder: str, codecs: tuple[str, ...] = CODECS) -> dict:
    """Bytes, seconds to write and to read for each codec, and the smallest."""
    out = {}
    for codec in codecs:
        path = f"{folder}/codec-{codec}.parquet"
        began = time.time()
        write_parquet(df, path, codec)
        wrote = time.time()
        df.sparkSession.read.parquet(path).write.format("noop").mode("overwrite").save()
        size = sum(files.parts(df.sparkSession, path).values())
        out[codec] = {"bytes": size, "write_seconds": round(wrote - began, 3), "read_seconds": round(time.time() - wrote, 3)}
    return {"codecs": out, "recommended": min(out, key=lambda c: out[c]["bytes"])}


def replace_source(df: DataFrame, path: str) -> str:
    """Write over the path that df may be reading: beside it first, then swap."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind not in (".csv", ".parquet"):
        raise ValueError(f"can't write {kind}")
    spark = df.sparkSession
    new = f"{path}.{uuid.uuid4().hex}{kind}"
    (write_csv if kind == ".csv" else write_parquet)(df, new, single_file=not files.is_folder(spark, path))
    return files.move(spark, new, path)
