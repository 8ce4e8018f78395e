"""The second query profile, over typed tables: aggregate, top_n and filter.

It differs from the first: unknown filter columns are skipped, ``!=`` keeps
nulls, ``contains`` is a case-insensitive regular expression, an empty sum is 0
and nulls sort last both ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

HEAD = 50


def condition(df: DataFrame, f: dict) -> Column | None:
    name, op, value = f.get("column"), f.get("operator", "=="), f.get("value")
    if name not in df.columns:
        return None
    c = F.col(name)
    if op == "contains":
        return F.coalesce(c.cast("string").rlike(f"(?i){value}"), F.lit(False))
    v = F.lit(float(value)) if isinstance(df.schema[name].dataType, NumericType) else F.lit(str(value))
    if op == "!=":
        return ~c.eqNullSafe(v)
    return {"==": c == v, "=": c == v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]


def filtered(df: DataFrame, filters: list[dict]) -> DataFrame:
    for f in filters:
        if (c := condition(df, f)) is not None:
            df = df.where(c)
    return df


def aggregate(df: DataFrame, function: str, column: str | None = None) -> DataFrame:
    if column is None:
        return df.agg(F.count(F.lit(1)).cast("double").alias("value"))
    c = F.col(column)
    made = {"mean": F.avg(c), "max": F.max(c), "min": F.min(c), "sum": F.coalesce(F.sum(c), F.lit(0)), "count": F.count(c)}[function]
    return df.agg(made.cast("double").alias("value"))


def top_n(df: DataFrame, by: str, n: int, ascending: bool = False, columns: list[str] | None = None, tie: str | None = None) -> DataFrame:
    order = [F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()] + ([F.col(tie)] if tie else [])
    kept = [c for c in columns or [] if c in df.columns] or df.columns
    return df.orderBy(*order).limit(n).select(*kept)


def run(df: DataFrame, ast: dict, tie: str | None = None) -> DataFrame:
    """{action, filters, aggregate: {function, column}, top_n: {column, n, ascending, columns}}"""
    df = df.toDF(*[c.strip() for c in df.columns])
    df = filtered(df, ast.get("filters") or [])
    if ast.get("action") == "aggregate":
        return aggregate(df, **ast["aggregate"])
    if ast.get("action") == "top_n":
        t = ast["top_n"]
        return top_n(df, t["column"], int(t.get("n", 5)), bool(t.get("ascending")), t.get("columns"), tie)
    return (df.orderBy(tie) if tie else df).limit(HEAD)
