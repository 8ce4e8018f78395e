"""Relationships between tables from their values: inclusions of columns, draft foreign keys and join paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.sources.readers import drop, kept

#: Values longer than this are no keys.
LONGEST = 64
#: Names of columns that are never looked into.
SENSITIVE = re.compile(r"card|ssn|password|secret|email|phone", re.IGNORECASE)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: How much of the confidence the values and the names give.
BY_VALUES, BY_NAME = 0.6, 0.4


def values(tables: dict[str, DataFrame]) -> DataFrame:
    """(tab, col, kind, value) of the whole-number and text columns of all tables, nulls left out; one scan a table."""
    out = None
    for name, df in sorted(tables.items()):
        cells = []
        for f in df.schema.fields:
            kind = "n" if isinstance(f.dataType, WHOLE) else "s" if isinstance(f.dataType, T.StringType) else None
            if kind and not SENSITIVE.search(f.name):
                cells.append(F.struct(F.lit(f.name).alias("col"), F.lit(kind).alias("kind"), F.col(f"`{f.name}`").cast("string").alias("value")))
        if cells:
            part = df.select(F.lit(name).alias("tab"), F.explode(F.array(*cells)).alias("c")).select("tab", "c.col", "c.kind", "c.value").where("value IS NOT NULL")
            out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no table has a column that could be a key")
    return out


def stem(column: Column) -> Column:
    """A column's name without a prefix of one letter: ``o_custkey`` and ``c_custkey`` are alike."""
    return F.lower(F.regexp_replace(column, "^[A-Za-z]_", ""))


def singular(word: Column) -> Column:
    w = F.lower(word)
    return F.when(w.endswith("ies"), F.concat(F.regexp_replace(w, "ies$", ""), F.lit("y"))).when(w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)


def inclusions(tables: dict[str, DataFrame]) -> DataFrame:
    """(tab, col, ref_tab, ref_col, n, shared, ref_unique): for all pairs of columns with a value in common, how many of the
    ``n`` distinct values of a column the other one has, and whether that one has each value once.

    One inverted pass: each value is given the set of columns that have it, equal sets are counted, and only these sets, of which
    there are few, are taken apart into pairs. No two columns' values are joined. Written."""
    cell = F.struct("tab", "col")
    counted = kept(values(tables).groupBy("tab", "col", "kind", "value").agg(F.count(F.lit(1)).alias("rows")), "values")
    profile = counted.groupBy("tab", "col").agg(F.count(F.lit(1)).alias("n"), (F.max("rows") == 1).alias("unique"), F.max(F.length("value")).alias("longest")).where(F.col("longest") <= LONGEST)
    keys = counted.join(F.broadcast(profile.select("tab", "col")), ["tab", "col"])  # a row a column
    sets = keys.groupBy("kind", "value").agg(F.array_sort(F.collect_set(cell)).alias("cols")).groupBy("cols").agg(F.count(F.lit(1)).alias("k"))
    pairs = sets.where(F.size("cols") > 1).select("k", F.explode("cols").alias("a"), "cols").select("k", "a", F.explode("cols").alias("b")).where("a <> b")
    shared = pairs.groupBy("a", "b").agg(F.sum("k").alias("shared"))
    own = profile.select(F.struct("tab", "col").alias("a"), "n")
    other = profile.select(F.struct("tab", "col").alias("b"), F.col("unique").alias("ref_unique"))
    found = shared.join(own, "a").join(other, "b").select("a.tab", "a.col", F.col("b.tab").alias("ref_tab"), F.col("b.col").alias("ref_col"), "n", "shared", "ref_unique")
    out = kept(found, "inclusions")
    drop(counted)
    return out


def relationships(tables: dict[str, DataFrame], declared: list[tuple[str, str, str, str]] = (), share: float = 0.95, least: float = 0.8) -> DataFrame:
    """(item_key, tab, col, ref_tab, ref_col, status, confidence): declared foreign keys are confirmed with confidence 1, others are drafts, where a
    column's values are nearly all among the unique values of another table's column and their names agree. ``least`` is the confidence of a draft."""
    found = inclusions(tables).where((F.col("tab") != F.col("ref_tab")) & F.col("ref_unique") & (F.col("shared") >= share * F.col("n")))
    same = stem(F.col("col")) == stem(F.col("ref_col"))
    of_table = F.contains(F.lower("col"), singular(F.col("ref_tab")))
    name = F.when(same, 1.0).when(of_table, 0.75).otherwise(0.0)
    drafts = found.select("tab", "col", "ref_tab", "ref_col", F.lit("draft").alias("status"), F.round(BY_VALUES * F.col("shared") / F.col("n") + BY_NAME * name, 4).alias("confidence")).where(F.col("confidence") >= least)
    known = found.sparkSession.createDataFrame(list(declared), "tab string, col string, ref_tab string, ref_col string")
    on = ["tab", "col", "ref_tab", "ref_col"]
    every = known.select(*on, F.lit("confirmed").alias("status"), F.lit(1.0).alias("confidence")).union(drafts.join(known, on, "left_anti"))
    return every.select(F.format_string("%s.%s->%s.%s", *on).alias("item_key"), *on, "status", "confidence")


def join_paths(edges: DataFrame) -> DataFrame:
    """(a, b, cost, path) of the cheapest way from each table to each other one over ``edges`` (tab, ref_tab, confidence), in either direction. An
    edge costs 1000 and what its confidence lacks in thousandths; ties go to the path that is first in the order of text. Rounds extend what became
    cheaper by one edge until nothing does; a catalogue's tables are few. Written."""
    price = F.round(1000 + 1000 * (1 - F.col("confidence"))).cast("long")
    one = edges.select("tab", "ref_tab", price.alias("cost"))
    ways = kept(one.union(one.select("ref_tab", "tab", "cost")).groupBy(F.col("tab").alias("a"), F.col("ref_tab").alias("b")).agg(F.min("cost").alias("cost")).where("a <> b"), "paths")
    best = kept(ways.select("a", "b", "cost", F.concat_ws(" -> ", "a", "b").alias("path")), "paths")
    new = best
    while True:
        step = ways.select(F.col("a").alias("m"), F.col("b").alias("z"), F.col("cost").alias("more"))
        longer = new.join(step, new["b"] == step["m"]).where("a <> z").select("a", F.col("z").alias("b"), (F.col("cost") + F.col("more")).alias("cost"), F.concat_ws(" -> ", "path", "z").alias("path"))
        merged = kept(best.union(longer).groupBy("a", "b").agg(F.min(F.struct("cost", "path")).alias("x")).select("a", "b", "x.cost", "x.path"), "paths")
        new = kept(merged.join(best.select("a", "b", F.col("cost").alias("c"), F.col("path").alias("p")), ["a", "b"], "left").where("c IS NULL OR cost < c OR path < p").select("a", "b", "cost", "path"), "paths")
        best = merged
        if new.isEmpty():
            drop(ways, new)
            return best
