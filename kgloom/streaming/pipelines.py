"""Incremental ingestion on Structured Streaming: file offsets and state live in the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Works off what there is and stops; running again continues where it stopped."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(each) if each else w.format("parquet").option("path", target)
    w.start().awaitTermination()


def timed(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant; a local timestamp is one in the session's zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def daily(stream: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    return timed(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("start"), "count")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return timed(stream, ts).withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("count")).select(key, F.col("w.start").alias("start"), "count")


def first_seen(stream: DataFrame, ts: str, keys: list[str], late: str = "2 days") -> DataFrame:
    return timed(stream, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
