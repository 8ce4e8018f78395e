"""Tables by name, and the modules that register queries."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ("tabular", "analytics", "joins", "windows", "text", "vectors", "graph", "resolution", "chunks", "metadata", "streams", "connectors", "sessions")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"kgloom.queries.{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_tenant(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """The rows of one tenant; a table without the column is refused rather than shown whole."""
    if column not in df.columns:
        raise ValueError(f"no {column} column: every read needs a tenant")
    return df.where(F.col(column) == tenant)
