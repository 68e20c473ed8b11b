"""Windowed measures, rule checks and sessions over a stream of events; the same functions take a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators import filters


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _late(events: DataFrame, time: str, delay: str) -> DataFrame:
    """A stream's watermark (it needs a timestamp with a time zone); tables stay as they are."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay) if events.isStreaming else events


def windowed(events: DataFrame, time: str = "ts", by: str = "event_type", value: str = "value", width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """window_start, by, n, total, mean: tumbling, or sliding windows; rows later than the delay are dropped from a stream."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = _late(events, time, delay).groupBy(w.alias("w"), F.col(by)).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total", "mean")


def sessions(events: DataFrame, time: str = "ts", by: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """by, session_start, session_end, n: runs of events with no gap as long as `gap`."""
    out = _late(events, time, delay).groupBy(F.session_window(time, gap).alias("w"), F.col(by)).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def violations(events: DataFrame, conditions: list[dict], time: str = "ts", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """window_start, rows, violations: rows that break any of the conditions {column, operator, value}."""
    good = filters.all_of([filters.condition(c["column"], c["operator"], c.get("value")) for c in conditions])
    out = _late(events, time, delay).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(good, F.lit(False))).alias("violations"))
    return out.select(F.col("w.start").alias("window_start"), "rows", "violations")


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once, within the delay."""
    return _late(events, time, delay).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over what is there and ends; started again, it goes on from its checkpoint."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
