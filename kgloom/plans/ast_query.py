"""JSON query plans over rows kept as JSON, compiled to DataFrame operations.

A plan names an operation (COUNT, AVG, MAX, MIN, SUM, GROUP, SORT, FILTER), a
target, conjunctive filters, a grouping and an order. It is validated against
the data set's declared schema before anything is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = ("COUNT", "AVG", "MAX", "MIN", "SUM", "GROUP", "SORT", "FILTER")
NUMERIC = ("float", "integer", "currency", "percentage")
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "LIKE", "ILIKE", "CONTAINS")
MOST_ROWS, USUAL_ROWS = 100, 50


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: object


@dataclass(frozen=True)
class Plan:
    operation: str
    target_field: str | None = None
    filters: tuple[Filter, ...] = ()
    group_by: str | None = None
    sort_by: str | None = None
    sort_dir: str = "DESC"
    limit: int | None = None

    @classmethod
    def of(cls, ast: dict) -> Plan:
        filters = tuple(Filter(f.get("field"), str(f.get("operator", "=")).upper(), f.get("value")) for f in ast.get("filters") or [])
        return cls(str(ast.get("operation", "")).upper(), ast.get("target_field"), filters, ast.get("group_by"), ast.get("sort_by"), str(ast.get("sort_dir") or "DESC").upper(), ast.get("limit"))


def problem(plan: Plan, schema: dict[str, str]) -> str | None:
    """Why the plan can't run, or None."""
    if plan.operation not in OPERATIONS:
        return f"Validation Error: Unsupported operation '{plan.operation}'"
    if plan.operation in ("AVG", "MAX", "MIN", "SUM"):
        if not plan.target_field:
            return f"Validation Error: Operation '{plan.operation}' requires a target field"
        if plan.target_field not in schema:
            return f"Validation Error: Column '{plan.target_field}' does not exist"
        if schema[plan.target_field] not in NUMERIC:
            return f"Validation Error: Column '{plan.target_field}' is not numeric"
    if plan.operation == "GROUP" and not plan.group_by:
        return "Validation Error: GROUP requires a group field"
    for what in (plan.group_by, plan.sort_by, *(f.field for f in plan.filters)):
        if what and what not in schema:
            return f"Validation Error: Column '{what}' does not exist"
    for f in plan.filters:
        if f.operator not in OPERATORS:
            return f"Validation Error: Unsupported operator '{f.operator}'"
    if plan.sort_by and (plan.operation in ("COUNT", "AVG", "MAX", "MIN", "SUM") or plan.operation == "GROUP" and plan.sort_by != plan.group_by):
        return "Validation Error: an aggregate can't be sorted by another column"
    return None


@dataclass
class Compiler:
    """Plans over ``rows``; ``strict`` makes a value that isn't a number fail the query, otherwise it is null."""

    schema: dict[str, str]
    row: str = "row_data"
    strict: bool = False
    cleaned: bool = False
    fixed: dict[str, str] = field(default_factory=dict)

    def text(self, name: str) -> Column:
        return F.col(self.fixed[name]).cast("string") if name in self.fixed else F.get_json_object(F.col(self.row), f"$.{name}")

    def number(self, name: str) -> Column:
        value = self.text(name)
        if self.cleaned:
            value = F.regexp_replace(value, "[^0-9.]", "")
        return value.cast("decimal(38,10)") if self.strict else value.try_cast("decimal(38,10)")

    def is_number(self, name: str) -> bool:
        return self.schema.get(name) in NUMERIC

    def condition(self, f: Filter) -> Column:
        if f.operator in ("LIKE", "ILIKE", "CONTAINS"):
            value = str(f.value)
            if f.operator == "CONTAINS" and not value.startswith("%"):
                value = f"%{value}%"
            return self.text(f.field).like(value) if f.operator == "LIKE" else self.text(f.field).ilike(value)
        left = self.number(f.field) if self.is_number(f.field) else self.text(f.field)
        right = F.lit(str(f.value)).cast("decimal(38,10)") if self.is_number(f.field) else F.lit(str(f.value))
        return {"=": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[f.operator]

    def order(self, name: str, direction: str) -> Column:
        key = self.number(name) if self.is_number(name) else self.text(name)
        return key.asc_nulls_last() if direction == "ASC" else key.desc_nulls_first()

    def run(self, rows: DataFrame, ast: dict, tie: str | None = None) -> DataFrame:
        plan = Plan.of(ast)
        if why := problem(plan, self.schema):
            raise ValueError(why)
        if plan.filters:
            rows = rows.where(reduce(lambda a, b: a & b, [self.condition(f) for f in plan.filters]))
        most = min(int(plan.limit or USUAL_ROWS), MOST_ROWS)
        if plan.operation == "COUNT":
            return rows.agg(F.count(F.lit(1)).alias("count"))
        if plan.operation in ("AVG", "MAX", "MIN", "SUM"):
            total = getattr(F, plan.operation.lower())(self.number(plan.target_field))
            return rows.agg(total.cast("double").alias("value"))
        if plan.operation == "GROUP":
            counted = rows.groupBy(self.text(plan.group_by).alias("group_key")).agg(F.count(F.lit(1)).alias("count"))
            if plan.sort_by:
                key = F.col("group_key")
                order = [key.asc_nulls_last() if plan.sort_dir == "ASC" else key.desc_nulls_first()]
            else:
                order = [F.desc("count"), F.col("group_key").asc_nulls_last()]
            return counted.orderBy(*order).limit(most)
        order = [self.order(plan.sort_by, plan.sort_dir)] if plan.sort_by else []
        order += [F.col(tie)] if tie else []
        return (rows.orderBy(*order) if order else rows).limit(most)
