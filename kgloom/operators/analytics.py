"""Operational analytics as column expressions and one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: US dollars for a million tokens in and out: fixed values.
PRICE_IN, PRICE_OUT = 0.15, 0.60
GROWTH = 1.15


def day(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def conditional_counts(df: DataFrame, status: Column, confidence: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(status == "SUCCESS").alias("answered"), F.count_if(status == "UNANSWERED").alias("unanswered"), F.round(F.coalesce(F.avg(confidence), F.lit(0.0)), 6).alias("avg_confidence"))


def daily_counts(df: DataFrame, ts: str, days: int = 30) -> DataFrame:
    """The first ``days`` days, oldest first."""
    return df.groupBy(day(ts).alias("day")).agg(F.count(F.lit(1)).alias("count")).orderBy("day").limit(days)


def histogram(df: DataFrame, share: Column, buckets: int = 5) -> DataFrame:
    """Counts by bucket of [0, 1], empty ones included; 1 belongs to the last."""
    counted = df.where(share.isNotNull()).groupBy(F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round(tokens_in / 1e6 * PRICE_IN + tokens_out / 1e6 * PRICE_OUT, 4)


def health(runs: Column, failures: Column, repair_rate: Column, fallbacks: Column) -> Column:
    return F.when(failures > 0.10 * runs, "CRITICAL").when((failures > 0) | (repair_rate > 0.20) | (fallbacks > 0), "DEGRADED").otherwise("HEALTHY")


def integrity(similarity: Column, retrieval: Column, loss: Column, chunks: Column) -> Column:
    """100 less penalties for weak reconstruction, weak retrieval and lost text; nothing stored scores 0."""
    weak = F.when(similarity < 0.85, 25).when(similarity < 0.95, 10).otherwise(0)
    lost = F.least(F.lit(30), F.floor(loss * 30).cast("int"))
    return F.when(chunks == 0, 0).otherwise(F.greatest(F.lit(0), 100 - weak - F.when(retrieval < 0.8, 20).otherwise(0) - lost)).cast("int")


def band(score: Column) -> Column:
    return F.when(score >= 95, "EXCELLENT").when(score >= 80, "GOOD").when(score >= 60, "DEGRADED").otherwise("FAILED")


def alerts(fallback: Column, retry: Column, repair: Column, drift: Column) -> Column:
    """An array of (rule, severity) that apply."""
    rules = [(fallback > 0.05, "fallback_rate", "CRITICAL"), (retry > 0.10, "retry_rate", "WARNING"), (repair > 0.20, "repair_rate", "WARNING"), (drift < -0.5, "baseline_drift", "WARNING")]
    return F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for c, n, s in rules]), lambda x: x.isNotNull())
