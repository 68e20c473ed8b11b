"""Lineage cuts in the shared checkpoint folder, and global ranks without a global sort in one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str = "kept") -> str:
    """A fresh path in the cluster's spark.checkpoint.dir (a temporary folder only where that is unset and all runs on one machine)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/brindle-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with rank (0, 1, ...) by the order columns: rows sorted in ranges, and each range's first rank from the ranges' counts."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed(dealt, "rank")


def placed(rows: DataFrame, name: str = "place") -> DataFrame:
    """Sorted rows with their place (0, 1, ...), from the counts of their partitions."""
    at = kept(rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__in")))
    sizes = {r[0]: r[1] for r in at.groupBy("__part").count().collect()}  # a row a partition
    base, bases = 0, []
    for part in sorted(sizes):
        bases += [F.lit(part), F.lit(base).cast("long")]
        base += sizes[part]
    first = F.create_map(*bases)[F.col("__part")] if bases else F.lit(0).cast("long")
    return at.withColumn(name, first + F.col("__in")).drop("__part", "__in")
