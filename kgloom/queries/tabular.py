"""Query plans over JSON rows and typed tables."""

import json

import pandas as pd
from pyspark.sql import functions as F

from kgloom.catalog import table
from kgloom.plans import csv_query
from kgloom.plans.ast_query import Compiler, Plan, problem
from kgloom.registry import query

SCHEMA = {"k": "integer", "event_type": "string", "value": "float", "user_id": "integer"}
FIXED = {"event_type": "event_type", "value": "value", "user_id": "user_id"}


def run(spark, sf, ast, **options):
    return Compiler(SCHEMA, row="props", fixed=FIXED, **options).run(table(spark, sf, "events"), ast, tie="event_id")


K = "try_cast(json_extract_string(props, '$.k') AS DOUBLE)"


@query("f01_json_projection", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS missing FROM events")
def f01(spark, sf):
    c = Compiler(SCHEMA, row="props")
    return table(spark, sf, "events").select("event_id", c.text("k").alias("k"), c.text("none").alias("missing"))


@query("f02_json_numeric", f"SELECT event_id, round({K}, 6) AS k, try_cast(event_type AS DOUBLE) AS bad FROM events")
def f02(spark, sf):
    c = Compiler(SCHEMA, row="props", fixed={"event_type": "event_type"})
    return table(spark, sf, "events").select("event_id", F.round(c.number("k").cast("double"), 6).alias("k"), c.number("event_type").cast("double").alias("bad"))


@query("f03_compare_filters", f"SELECT count(*) FILTER ({K} = 7) AS eq, count(*) FILTER ({K} <> 7) AS ne, count(*) FILTER ({K} > 50) AS gt, count(*) FILTER ({K} < 50) AS lt, count(*) FILTER ({K} >= 50) AS ge, count(*) FILTER (event_type <= 'error') AS le FROM events")
def f03(spark, sf):
    from kgloom.plans.ast_query import Filter

    c = Compiler(SCHEMA, row="props", fixed=FIXED)
    made = {"eq": ("k", "=", 7), "ne": ("k", "!=", 7), "gt": ("k", ">", 50), "lt": ("k", "<", 50), "ge": ("k", ">=", 50), "le": ("event_type", "<=", "error")}
    return table(spark, sf, "events").agg(*[F.count_if(c.condition(Filter(*f))).alias(n) for n, f in made.items()])


@query("f04_like_ilike", "SELECT count(*) FILTER (p_name LIKE '%ring') AS like_n, count(*) FILTER (p_name ILIKE '%RING') AS ilike_n FROM part")
def f04(spark, sf):
    from kgloom.plans.ast_query import Filter

    c = Compiler({"p_name": "string"}, fixed={"p_name": "p_name"})
    return table(spark, sf, "part").agg(F.count_if(c.condition(Filter("p_name", "LIKE", "%ring"))).alias("like_n"), F.count_if(c.condition(Filter("p_name", "ILIKE", "%RING"))).alias("ilike_n"))


@query("f05_contains", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET%' ORDER BY p_partkey LIMIT 100")
def f05(spark, sf):
    plan = {"operation": "FILTER", "filters": [{"field": "p_name", "operator": "contains", "value": "WIDGET"}], "limit": 500}
    return Compiler({"p_name": "string"}, fixed={"p_name": "p_name"}).run(table(spark, sf, "part"), plan, tie="p_partkey").select("p_partkey", "p_name")


@query("f06_conjunction", f"SELECT count(*) AS count FROM events WHERE {K} > 10 AND {K} <= 60 AND event_type = 'click'")
def f06(spark, sf):
    return run(spark, sf, {"operation": "COUNT", "filters": [{"field": "k", "operator": ">", "value": 10}, {"field": "k", "operator": "<=", "value": 60}, {"field": "event_type", "operator": "=", "value": "click"}]})


CASES = [
    ({"operation": "COUNT"}, None),
    ({"operation": "DROP"}, "Validation Error: Unsupported operation 'DROP'"),
    ({"operation": "AVG"}, "Validation Error: Operation 'AVG' requires a target field"),
    ({"operation": "SUM", "target_field": "nope"}, "Validation Error: Column 'nope' does not exist"),
    ({"operation": "MAX", "target_field": "event_type"}, "Validation Error: Column 'event_type' is not numeric"),
    ({"operation": "GROUP"}, "Validation Error: GROUP requires a group field"),
    ({"operation": "FILTER", "filters": [{"field": "k; DROP TABLE x", "operator": "=", "value": 1}]}, "Validation Error: Column 'k; DROP TABLE x' does not exist"),
    ({"operation": "COUNT", "sort_by": "k"}, "Validation Error: an aggregate can't be sorted by another column"),
]


MESSAGES = "[" + ", ".join("NULL" if m is None else "'" + m.replace("'", "''") + "'" for _, m in CASES) + "]"


@query("f07_ast_validation", f"SELECT event_id, list_extract({MESSAGES}, (event_id % {len(CASES)} + 1)::INT) AS message FROM events")
def f07(spark, sf):
    """Plans as JSON text, one for each event, each with what is wrong with it."""

    @F.pandas_udf("string")
    def wrong(plans: pd.Series) -> pd.Series:
        told = {text: problem(Plan.of(json.loads(text)), SCHEMA) for text in plans.unique()}
        return plans.map(told)

    plans = F.array(*[F.lit(json.dumps(plan)) for plan, _ in CASES])
    e = table(spark, sf, "events")
    return e.select("event_id", wrong(F.element_at(plans, (F.col("event_id") % len(CASES) + 1).cast("int"))).alias("message"))


@query("a01_ast_count", f"SELECT count(*) AS count FROM events WHERE {K} >= 50")
def a01(spark, sf):
    return run(spark, sf, {"operation": "COUNT", "filters": [{"field": "k", "operator": ">=", "value": 50}]})


for _op in ("AVG", "MAX", "MIN", "SUM"):

    @query(f"a02_ast_{_op.lower()}", f"SELECT round({_op}({K}), 6) AS value FROM events WHERE event_type ILIKE '%i%'")
    def a02(spark, sf, op=_op):
        return run(spark, sf, {"operation": op, "target_field": "k", "filters": [{"field": "event_type", "operator": "CONTAINS", "value": "i"}]}).select(F.round("value", 6).alias("value"))


@query("a03_ast_group", "SELECT event_type AS group_key, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def a03(spark, sf):
    return run(spark, sf, {"operation": "GROUP", "group_by": "event_type"})


@query("t01_ast_sort_desc", f"SELECT event_id, json_extract_string(props, '$.k') AS k FROM events ORDER BY {K} DESC NULLS FIRST, event_id LIMIT 50")
def t01(spark, sf):
    return run(spark, sf, {"operation": "SORT", "sort_by": "k"}).select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("t01_ast_sort_text_asc", "SELECT event_id, event_type FROM events ORDER BY event_type ASC NULLS LAST, event_id LIMIT 20")
def t01_asc(spark, sf):
    return run(spark, sf, {"operation": "SORT", "sort_by": "event_type", "sort_dir": "asc", "limit": 20}).select("event_id", "event_type")


@query("t02_ast_limit_guard", "SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def t02(spark, sf):
    return run(spark, sf, {"operation": "FILTER", "limit": 100000}).select("event_id")


@query("f08_csv_filter", "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_returnflag IS DISTINCT FROM 'A'")
def f08(spark, sf):
    kept = csv_query.filtered(table(spark, sf, "lineitem"), [{"column": "l_quantity", "operator": ">=", "value": "10"}, {"column": "not_there", "operator": "==", "value": 1}, {"column": "l_returnflag", "operator": "!=", "value": "A"}])
    return kept.agg(F.count(F.lit(1)).alias("n"))


@query("f09_csv_contains", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RED|blue.*t$')")
def f09(spark, sf):
    return csv_query.filtered(table(spark, sf, "part"), [{"column": "p_name", "operator": "contains", "value": "RED|blue.*t$"}]).select("p_partkey", "p_name")


@query("a04_csv_aggregates", "SELECT 'mean' AS f, round(avg(l_quantity), 6) AS value FROM lineitem UNION ALL SELECT 'max', max(l_quantity) FROM lineitem UNION ALL SELECT 'min', min(l_quantity) FROM lineitem UNION ALL SELECT 'sum', round(sum(l_quantity), 6) FROM lineitem UNION ALL SELECT 'count', count(l_quantity)::DOUBLE FROM lineitem UNION ALL SELECT 'rows', count(*)::DOUBLE FROM lineitem UNION ALL SELECT 'empty_sum', 0.0")
def a04(spark, sf):
    df = table(spark, sf, "lineitem")
    c = F.col("l_quantity")
    one = df.agg(F.avg(c).alias("mean"), F.max(c).alias("max"), F.min(c).alias("min"), F.sum(c).alias("sum"), F.count(c).cast("double").alias("count"), F.count(F.lit(1)).cast("double").alias("rows"), F.coalesce(F.sum(F.when(c < 0, c)), F.lit(0.0)).alias("empty_sum"))
    return one.selectExpr("stack(7, 'mean', mean, 'max', max, 'min', min, 'sum', sum, 'count', count, 'rows', rows, 'empty_sum', empty_sum) as (f, value)").select("f", F.round("value", 6).alias("value"))


@query("a04_csv_aggregate_plan", "SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_discount > 0.05")
def a04_plan(spark, sf):
    plan = {"action": "aggregate", "filters": [{"column": "l_discount", "operator": ">", "value": 0.05}], "aggregate": {"function": "sum", "column": "l_extendedprice"}}
    return csv_query.run(table(spark, sf, "lineitem"), plan).select(F.round("value", 2).alias("value"))


@query("t03_csv_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 15")
def t03(spark, sf):
    plan = {"action": "top_n", "top_n": {"column": "o_totalprice", "n": 15, "columns": ["o_orderkey", "o_totalprice", "unknown"]}}
    return csv_query.run(table(spark, sf, "orders"), plan, tie="o_orderkey")


@query("t04_csv_head", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 100 ORDER BY c_custkey LIMIT 50")
def t04(spark, sf):
    plan = {"action": "filter", "filters": [{"column": "c_acctbal", "operator": "<", "value": 100}]}
    return csv_query.run(table(spark, sf, "customer"), plan, tie="c_custkey").select("c_custkey", "c_name")


@query("f11_in_list", "SELECT count(*) AS n FROM customer WHERE c_nationkey IN (1, 5, 9)")
def f11(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_nationkey").isin(1, 5, 9)).agg(F.count(F.lit(1)).alias("n"))


@query("f10_tenant_predicate", "SELECT source AS tenant_id, doc_id FROM documents WHERE source = 'src3'")
def f10(spark, sf):
    from kgloom.catalog import for_tenant

    return for_tenant(table(spark, sf, "documents").withColumnRenamed("source", "tenant_id"), "src3").select("tenant_id", "doc_id")


@query("f12_keyword_or", "SELECT doc_id FROM documents WHERE contains(text, 'License') OR contains(text, 'rights')")
def f12(spark, sf):
    from functools import reduce

    return table(spark, sf, "documents").where(reduce(lambda a, b: a | b, [F.contains("text", F.lit(w)) for w in ("License", "rights")])).select("doc_id")


@query("f13_soft_delete", "SELECT count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) AS total FROM orders")
def f13(spark, sf):
    return table(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") != "F").alias("active"), F.count(F.lit(1)).alias("total"))


@query("f15_threshold", "SELECT event_id FROM events WHERE value >= 0.7 * 100")
def f15(spark, sf):
    return table(spark, sf, "events").where(F.col("value") >= 0.7 * 100).select("event_id")


@query("f16_confidence_status", "SELECT CASE WHEN l_discount * 10 < 0.8 THEN 'REVIEW' ELSE 'VERIFIED' END AS status, max(CASE WHEN l_discount * 10 < 0.8 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END) AS trust, count(*) AS n FROM lineitem GROUP BY 1")
def f16(spark, sf):
    status = F.when(F.col("l_discount") * 10 < 0.8, "REVIEW").otherwise("VERIFIED")
    return table(spark, sf, "lineitem").groupBy(status.alias("status")).agg(F.max(F.when(status == "REVIEW", 0.8).otherwise(1.0)).alias("trust"), F.count(F.lit(1)).alias("n"))


@query("f17_requested_entities", "SELECT p_partkey FROM part WHERE lower(p_type) IN ('economy') OR contains('show me every small ring please', lower(p_name))")
def f17(spark, sf):
    return table(spark, sf, "part").where(F.lower("p_type").isin("economy") | F.contains(F.lit("show me every small ring please"), F.lower("p_name"))).select("p_partkey")


@query("f18_completeness", "SELECT c_nationkey, count(DISTINCT c_mktsegment) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) = 2 AS complete FROM customer GROUP BY 1")
def f18(spark, sf):
    wanted = F.array(F.lit("BUILDING"), F.lit("MACHINERY"))
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("found")).select("c_nationkey", (F.size(F.array_except(wanted, F.col("found"))) == 0).alias("complete"))


@query("f19_multi_column_search", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%77%' OR c_mktsegment ILIKE '%house%'")
def f19(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_name").ilike("%77%") | F.col("c_mktsegment").ilike("%house%")).select("c_custkey")
