"""Upserts that don't rewrite their target: a delta for each batch, merged on reading, compacted from time to time.

``batch=n`` holds the newest row of each key of batch n, ``base=n`` the newest of all batches up to n. A batch that runs again writes
its delta again. A base counts once it is complete; what it holds is deleted after that, so a reader or a crash in between
loses nothing. Both are dealt by the hash of the keys, so that a reader of some keys needs some files only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def newest_rows(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row a key, the one with the greatest version."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_v")).select(*keys, "_v.*").select(*df.columns)


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def parts(spark: SparkSession, target: str) -> tuple[int | None, list[int]]:
    """The number of the newest complete base, and those of the batches after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None, []
    bases, batches = [], []
    for s in fs.listStatus(path):
        kind, _, n = s.getPath().getName().partition("=")
        if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            (bases if kind == "base" else batches).append(int(n))
    base = max(bases, default=None)
    return base, sorted(b for b in batches if base is None or b > base)


def read(spark: SparkSession, target: str, keys: list[str], version: list[str], schema) -> DataFrame:
    """The newest row of each key of all batches: the base and the deltas after it are merged."""
    base, batches = parts(spark, target)
    paths = ([f"{target}/base={base}"] if base is not None else []) + [f"{target}/batch={n}" for n in batches]
    if not paths:
        return spark.createDataFrame([], schema)
    out = None
    for p in paths:
        df = spark.read.schema(schema).parquet(p).select(*[f.name for f in schema.fields])
        out = df if out is None else out.union(df)
    return newest_rows(out, keys, version)


def compact(spark: SparkSession, target: str, keys: list[str], version: list[str], schema, buckets: int = BUCKETS) -> None:
    """One base for all batches there are; then what it holds goes."""
    base, batches = parts(spark, target)
    if not batches:
        return
    n = batches[-1]
    read(spark, target, keys, version, schema).withColumn("bucket", bucket(keys, buckets)).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/base={n}")
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(path):
        kind, _, i = s.getPath().getName().partition("=")
        if i.isdigit() and (int(i) <= n if kind == "batch" else int(i) < n):
            fs.delete(s.getPath(), True)


def upserter(target: str, keys: list[str], version: list[str], every: int = 10, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes what the batch brings, and compacts after each ``every`` batches."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        base, _ = parts(spark, target)
        if base is None or n > base:  # a batch that a base holds already isn't written again
            newest_rows(batch, keys, version).withColumn("bucket", bucket(keys, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={n}")
        if every and (n + 1) % every == 0:
            compact(spark, target, keys, version, batch.schema, buckets)

    return write
