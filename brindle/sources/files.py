"""Small whole files (templates, rules, mappings, reports) in any place that Spark's file systems reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _place(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _place(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Written beside the path and moved there, so that readers never see half a file."""
    fs, beside = _place(spark, f"{path}.new")
    stream = fs.create(beside, True)
    stream.write(data)
    stream.close()
    return move(spark, f"{path}.new", path)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    return write_bytes(spark, path, text.encode("utf-8"))


def move(spark: SparkSession, source: str, target: str) -> str:
    """Put a file or folder in another's place."""
    fs, at = _place(spark, target)
    if fs.exists(at):
        fs.delete(at, True)
    if not fs.rename(_place(spark, source)[1], at):
        raise OSError(f"can't write {target}")
    return target


def remove(spark: SparkSession, path: str) -> bool:
    fs, at = _place(spark, path)
    return fs.delete(at, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _place(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def parts(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names and sizes of a folder's data files."""
    fs, at = _place(spark, folder)
    held = {s.getPath().getName(): s.getLen() for s in fs.listStatus(at)}
    return {n: size for n, size in sorted(held.items()) if n.startswith("part-")}
