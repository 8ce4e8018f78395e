"""Upserts, merges and deletes as rewrites: plain Parquet has no MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row a key, the one with the greatest version; max_by aggregates before the shuffle, a window would not."""
    rest = [c for c in old.columns if c not in keys]
    every = old.select(*keys, *rest).unionByName(new.select(*keys, *rest))
    latest = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_v"))
    return latest.select(*keys, "_v.*")


def merged(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Existing values stay and fill up from the new rows; ``created`` marks keys that weren't there."""
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.alias("b")
    joined = a.join(b, keys, "full")
    return joined.select(*keys, *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in columns], F.col("_old").isNull().alias("created"))


def idempotent(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.dropDuplicates(keys)


def replaced(old: DataFrame, new: DataFrame, partition: str) -> DataFrame:
    """``old`` with the partitions that occur in ``new`` taken from it (dynamic overwrite)."""
    touched = new.select(partition).distinct()
    return old.join(touched, partition, "left_anti").select(*old.columns).unionByName(new)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone, keys, "left_anti")


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
