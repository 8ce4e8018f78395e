"""Vector arithmetic on array columns with higher-order functions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def inner(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Raw cosine in [-1, 1]; null where a norm is 0."""
    return F.try_divide(inner(a, b), norm(a) * norm(b))


def unit_cosine(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 in [0, 1]; longer vectors are cut to the shorter, 0 for empty ones and zero norms."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    return F.when(n <= 0, 0.0).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine(x, y) + 1) / 2)), F.lit(0.0)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(doubles(a), lambda x: F.try_divide(x, n))


def binary(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def top_k(df: DataFrame, vector: str, query: Column, k: int, tie: str, score: str = "similarity", unit: bool = False) -> DataFrame:
    """The k most similar rows; keeps k rows a partition before the last merge."""
    made = unit_cosine(F.col(vector), query) if unit else cosine(F.col(vector), query)
    return df.withColumn(score, made).orderBy(F.desc(score), tie).limit(k)


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector by key: positions are averaged with partial aggregates and put in order again."""
    parts = df.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))
