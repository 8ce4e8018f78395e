"""Type inference, value indexes, schema differences, quality reports and guards."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOOLEANS = ["true", "false", "yes", "no", "t", "f"]
CURRENCY = r"^[$€£₹]\s*\d+([,.]\d+)?"
PERCENT = r"^\d+([,.]\d+)?\s*%$"


def infer_types(df: DataFrame, order: str) -> DataFrame:
    """(column, type) of every string column, in one pass: string if all are null, boolean by values,
    integer or float if every value is a number, datetime if every value parses, currency or percentage
    by the first value, else string."""
    names = [c for c in df.columns if c != order]
    aggs = []
    for c in names:
        v = F.trim(F.col(c))
        n = v.try_cast("double")
        aggs += [
            F.count(v).alias(f"{c}__n"),
            F.count_if(F.lower(v).isin(*BOOLEANS)).alias(f"{c}__b"),
            F.count(n).alias(f"{c}__d"),
            F.count_if(n == F.floor(n)).alias(f"{c}__i"),
            F.count_if(v.rlike("[-/:]") & v.try_cast("timestamp").isNotNull()).alias(f"{c}__t"),
            F.min_by(v, F.when(v.isNotNull(), F.col(order))).alias(f"{c}__f"),
        ]
    one = df.agg(*aggs)
    rows = []
    for c in names:
        n = F.col(f"{c}__n")
        kind = (
            F.when(n == 0, "string").when(F.col(f"{c}__b") == n, "boolean").when((F.col(f"{c}__d") == n) & (F.col(f"{c}__i") == n), "integer").when(F.col(f"{c}__d") == n, "float")
            .when(F.col(f"{c}__t") == n, "datetime").when(F.col(f"{c}__f").rlike(CURRENCY + "$"), "currency").when(F.col(f"{c}__f").rlike(PERCENT), "percentage").otherwise("string")
        )
        rows.append(F.struct(F.lit(c).alias("column"), kind.alias("type")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.column", "r.type")


def headers(cells: list[str | None]) -> list[str]:
    """Normalised names; blanks are numbered and repeats get _1, _2."""
    out, seen = [], {}
    for i, c in enumerate(cells):
        name = re.sub("[^a-z0-9]+", "_", (c or "").lower()).strip("_") or f"unnamed_col_{i}"
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(f"{name}_{k}" if k else name)
    return out


def value_index(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("p")
    return df.select(pairs).where("p.value is not null").groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("frequency"))


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events between two catalogues (tbl, col, typ): added, removed, retyped, same."""
    j = old.withColumnRenamed("typ", "before").join(new.withColumnRenamed("typ", "after"), ["tbl", "col"], "full")
    kind = F.when(F.col("before").isNull(), "COLUMN_ADDED").when(F.col("after").isNull(), "COLUMN_REMOVED").when(F.col("before") != F.col("after"), "TYPE_CHANGED").otherwise("UNCHANGED")
    return j.select("tbl", "col", kind.alias("event"))


def catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame([(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema], "tbl string, col string, typ string")


#: Roles of columns by name: fixed patterns, first match wins.
ROLES = [("identifier", r"(_id|key|uuid)$"), ("timestamp", r"(date|_at|time|ts)$"), ("amount", r"(amt|amount|price|total|bal|cost)"), ("ratio", r"(percent|pct|rate|discount|tax)"), ("count", r"(count|qty|quantity|number|size|n_)"), ("flag", r"(^is_|flag|status)"), ("name", r"(name|title)")]
SENSITIVE = [("email", r"[\w.+-]+@[\w-]+\.[\w.]+"), ("card", r"\b(?:\d[ -]?){13,19}\b"), ("phone", r"\+\d[\d ()-]{8,}\d"), ("token", r"\b[a-f0-9]{32,}\b")]


def role(name: Column) -> Column:
    out = F.lit("attribute")
    for kind, p in reversed(ROLES):
        out = F.when(F.lower(name).rlike(p), kind).otherwise(out)
    return out


def sensitive_kind(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, p in reversed(SENSITIVE):
        out = F.when(value.rlike(p), kind).otherwise(out)
    return out


def masked(value: Column) -> Column:
    for _, p in SENSITIVE:
        value = F.regexp_replace(value, p, "***")
    return value


def foreign_key_share(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """The share of a column's distinct values that occur as keys."""
    c = child.select(F.col(column).alias("v")).where("v is not null").distinct()
    p = parent.select(F.col(key).alias("v")).distinct().withColumn("hit", F.lit(1))
    return c.join(p, "v", "left").agg(F.round(F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1)), 6).alias("share"))


def guarded_sql(sql: str, tables: set[str], most: int = 100) -> str:
    """A single SELECT over known tables with a limit, or ValueError."""
    text = sql.strip().rstrip(";")
    if ";" in text or not re.match(r"(?is)^\s*(select|with)\b", text) or re.search(r"(?i)\b(insert|update|delete|drop|alter|create|truncate|grant|merge)\b", text):
        raise ValueError("only one SELECT is allowed")
    made = set(re.findall(r"(?i)\b(\w+)\s+as\s*\(", text))
    for t in re.findall(r"(?i)\b(?:from|join)\s+([\w.]+)", text):
        if t.lower() not in tables and t not in made:
            raise ValueError(f"unknown table {t}")
    return text if re.search(r"(?i)\blimit\s+\d+\s*$", text) else f"{text} LIMIT {most}"


def metric_columns(expression: str, df: DataFrame) -> list[str]:
    """The columns a metric uses; an unknown one raises ValueError."""
    words = set(re.findall(r"(?<![\w'])([A-Za-z_]\w*)(?!\s*\(|\w)", re.sub(r"'[^']*'", "", expression)))
    words -= {w for w in words if w.upper() in {"AND", "OR", "NOT", "CASE", "WHEN", "THEN", "ELSE", "END", "DISTINCT", "AS", "NULL", "IS", "IN"}}
    unknown = sorted(words - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    return sorted(words)


def plural_variants(word: str) -> list[str]:
    """Singular and plural forms, without cutting words that end in us, ss, is or ws."""
    w, out = word.lower(), {word.lower()}
    if w.endswith("ies") and len(w) > 4:
        out.add(w[:-3] + "y")
    elif re.search(r"(ss|us|is|sh|ch|x|z)es$", w):
        out.add(w[:-2])
    elif w.endswith("s") and not re.search(r"(ss|us|is|ws)$", w):
        out.add(w[:-1])
    if re.search(r"[^aeiou]y$", w):
        out.add(w[:-1] + "ies")
    elif re.search(r"(s|sh|ch|x|z)$", w) and not (w.endswith("s") and len(out) > 1):
        out.add(w + "es")
    elif not w.endswith("s"):
        out.add(w + "s")
    return sorted(out)


def plural_forms(word: Column) -> Column:
    """``plural_variants`` of a column, sorted: whole tables of words without Python."""
    w = F.lower(word)
    part = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    base = F.when(w.endswith("ies") & (F.length(w) > 4), F.array(w, F.concat(part(3), F.lit("y")))).when(w.rlike(r"(ss|us|is|sh|ch|x|z)es$"), F.array(w, part(2)))
    base = base.when(w.endswith("s") & ~w.rlike(r"(ss|us|is|ws)$"), F.array(w, part(1))).otherwise(F.array(w))
    more = F.when(w.rlike(r"[^aeiou]y$"), F.concat(part(1), F.lit("ies"))).when(w.rlike(r"(s|sh|ch|x|z)$") & ~(w.endswith("s") & (F.size(base) > 1)), F.concat(w, F.lit("es")))
    more = more.when(~w.endswith("s"), F.concat(w, F.lit("s")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(base, F.array(more)), lambda x: x.isNotNull())))


def idf(n: Column, total: Column) -> Column:
    """1 for a term of one document, 0 for one in all: log(total / n) / log(total)."""
    return F.when(total <= 1, 1.0).otherwise(F.ln(total / n) / F.ln(total))


def rrf(ranks: list[Column], k: int = 60) -> Column:
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(F.try_divide(F.lit(1.0), k + r), F.lit(0.0))
    return out


def shortest_path(edges: list[tuple[str, str, float]], a: str, b: str) -> list[str]:
    """The cheapest join path over confirmed relationships; a catalogue's tables, so on the driver."""
    import heapq

    near: dict[str, list[tuple[float, str]]] = {}
    for x, y, w in edges:
        near.setdefault(x, []).append((w, y))
        near.setdefault(y, []).append((w, x))
    heap, done = [(0.0, a, [a])], set()
    while heap:
        cost, node, path = heapq.heappop(heap)
        if node == b:
            return path
        if node not in done:
            done.add(node)
            for w, y in near.get(node, ()):
                if y not in done and math.isfinite(w):
                    heapq.heappush(heap, (cost + w, y, [*path, y]))
    return []
