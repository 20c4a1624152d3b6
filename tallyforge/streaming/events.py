"""Streaming forms: incremental health, weekly windows, key de-duplication. Batch and stream share expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_health(stream: DataFrame, by: str, value: str) -> DataFrame:
    return stream.groupBy(by).agg(F.count("*").alias("rows"), F.sum(F.col(value).isNull().cast("long")).alias("nulls"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("total"))


def weekly(stream: DataFrame, ts: str, value: str, late: str = "7 days") -> DataFrame:
    """Weeks from Tuesday 00:00 to Monday; the epoch was a Thursday, hence the offset."""
    w = F.window(ts, "7 days", "7 days", "5 days")
    out = (stream.withWatermark(ts, late) if stream.isStreaming else stream).groupBy(w).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("week_start"), "n", "mean")


def first_per_key(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """One row per key within the watermark. A stream keeps the first arrival, a batch any row."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])


def collect_stream(spark, path: str, schema, build, name: str, folder: str, mode: str = "complete") -> DataFrame:
    """Runs ``build`` over the files of ``path`` as a stream until all are read, and returns what it wrote to memory."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
    query = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
